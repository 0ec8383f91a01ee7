"""G.711 companding as column expressions over byte values 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ulaw(byte: Column) -> Column:
    """Linear value of a mu-law byte; a magnitude of 0 counts as 4."""
    u = F.bitwise_not(byte.cast("int")).bitwiseAND(F.lit(255))
    exponent = F.shiftright(u, 4).bitwiseAND(F.lit(7))
    # Each segment starts where the one before ends: 132 * (2^e - 1).
    size = (F.pow(F.lit(2), exponent) - 1) * 132 + u.bitwiseAND(F.lit(15)) * F.pow(F.lit(2), exponent + 3)
    size = F.when(size == 0, 4).otherwise(size.cast("int"))
    return F.when(u.bitwiseAND(F.lit(128)) != 0, -size).otherwise(size).cast("int")


def alaw(byte: Column) -> Column:
    """Linear value of an A-law byte."""
    a = byte.cast("int").bitwiseXOR(F.lit(0x55))
    segment = F.shiftright(a, 4).bitwiseAND(F.lit(7))
    step = a.bitwiseAND(F.lit(15)) * 16 + 8
    size = F.when(segment == 0, step).otherwise((step + 256) * F.pow(F.lit(2), segment - 1).cast("int"))
    return F.when(a.bitwiseAND(F.lit(128)) != 0, size).otherwise(-size).cast("int")
