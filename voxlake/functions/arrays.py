"""Vector algebra as expressions over array columns; operands of different lengths raise an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _paired(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, each)).otherwise(F.raise_error("vectors differ in length").cast("array<double>"))


def add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x / y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def shift(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x + by)


def constant(value: Column, size: Column) -> Column:
    return F.array_repeat(value, size)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def inner(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def deviation(a: Column, floor: float = 0.0) -> Column:
    """Population standard deviation, `floor` at least."""
    squares = total(F.transform(a, lambda x: x * x)) / F.size(a) - mean(a) * mean(a)
    return F.greatest(F.sqrt(F.greatest(squares, F.lit(0.0))), F.lit(floor))


def outer(a: Column, b: Column) -> Column:
    """Products of all pairs, row after row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def add_diagonal(matrix: Column, size: int, value: Column) -> Column:
    """A square matrix, row after row, with a value added on its diagonal."""
    return F.transform(matrix, lambda x, k: F.when(k % (size + 1) == 0, x + value).otherwise(x))
