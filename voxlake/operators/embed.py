"""Supervectors, i-vectors, nuisance projection, and scores of trials with their normalisations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gmm import Mixture, map_adapt

#: Numbers of one packed row of vectors (16 MB).
VALUES = 2_000_000


def supervector(statistics: DataFrame, model: Mixture, relevance: float) -> DataFrame:
    """(utt, vec): 0, then each Gaussian's shift of means in units of its deviation, weighted by the root of its share of frames."""
    adapted = map_adapt(statistics, model, relevance)
    total = adapted.groupBy("utt").agg(F.sum("ec").alias("total"))
    weight = F.sqrt(F.col("ec") / F.col("total"))
    shift = F.zip_with(F.zip_with("mean", "mu", lambda a, b: a - b), "inv_var", lambda v, i: v * F.sqrt(i) * weight)
    rows = adapted.join(total, "utt").select("utt", "mix", shift.alias("v"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("mix", "v"))), lambda x: x["v"]))
    return rows.groupBy("utt").agg(F.concat(F.array(F.lit(0.0)), whole).alias("vec"))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _projected(batches: Iterator[pa.RecordBatch], rows: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(name)
        x = np.asarray(column.flatten(), float).reshape(-1, rows.shape[1])
        for r in rows:
            x = x - (x @ r)[:, None] * r
        own = np.zeros(batch.num_rows, np.int64)
        own[np.asarray(column.is_valid())] = rows.shape[1]
        offsets = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32), mask=np.append(np.asarray(column.is_null()), False))
        new = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([new if f.name == name else batch.column(f.name) for f in batch.schema], names=batch.schema.names)


def project_out(vectors: DataFrame, rows: list[list[float]], corank: int, name: str = "vec") -> DataFrame:
    """Subtract the projection on each of the first `corank` rows, one after another; 0 leaves the vectors. A null vector stays null.

    The rows go to the tasks as one matrix, so the plan doesn't grow with them.
    """
    if not 0 <= corank <= len(rows):
        raise ValueError("corank is larger than the projection")
    own = vectors.withColumn(name, F.col(name).cast("array<double>"))
    return own.mapInArrow(partial(_projected, rows=np.asarray(rows, float)[:corank], name=name), own.schema) if corank else own


def _without(batches: Iterator[pa.RecordBatch], model: Mixture, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    m, d = model.mean.shape
    root = np.exp(0.5 * model.log_weight)
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = batch.column("mean").flatten().to_numpy().reshape(-1, m, d)
        ec = batch.column("ec").flatten().to_numpy().reshape(-1, m)
        shift = (mean - model.mean) * np.sqrt(model.inv_var) * root[:, None]
        x = np.concatenate([np.zeros((len(mean), 1)), shift.reshape(len(mean), -1)], axis=1)
        for r in rows:
            x = x - (x @ r)[:, None] * r
        share = np.sqrt(ec / np.maximum(ec.sum(1, keepdims=True), 1e-8)) / root
        x[:, 1:] *= np.repeat(share, d, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("utt"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["utt", "vec"])


def supervector_without(statistics: DataFrame, model: Mixture, relevance: float, rows: np.ndarray, corank: int) -> DataFrame:
    """(utt, vec): the supervector without the first `corank` rows' directions.

    Shifts are weighted by the roots of the model's own weights while the directions are taken out, and by the
    roots of the shares of frames afterwards. Corank 0 gives `supervector`.
    """
    if not 0 <= corank <= len(rows):
        raise ValueError("corank is larger than the projection")
    if corank and rows.shape[1] != model.mean.size + 1:
        raise ValueError("the projection has another dimension than the supervector")
    adapted = map_adapt(statistics, model, relevance)
    sorted_ = F.array_sort(F.collect_list(F.struct("mix", "ec", "mean")))
    packed = adapted.groupBy("utt").agg(sorted_.alias("s")).select(F.col("utt").cast("long").alias("utt"), F.transform("s", lambda x: x["ec"]).alias("ec"), F.flatten(F.transform("s", lambda x: x["mean"])).alias("mean"))
    return packed.mapInArrow(partial(_without, model=model, rows=np.asarray(rows, float)[:corank]), "utt long, vec array<double>")


def _solve(batches: Iterator[pa.RecordBatch], total: np.ndarray, model: Mixture) -> Iterator[pa.RecordBatch]:
    m, d = model.mean.shape
    blocks = total.reshape(m, d, -1)
    scaled = blocks * model.inv_var[:, :, None]
    grams = np.einsum("mdr,mds->mrs", scaled, blocks)
    for batch in batches:
        out = []
        for ec, f in zip(batch.column("ec").to_pylist(), batch.column("f").to_pylist(), strict=True):
            ec, f = np.array(ec), np.array(f)
            left = np.einsum("m,mrs->rs", ec, grams)
            right = np.einsum("mdr,md->r", scaled, f - ec[:, None] * model.mean)
            out.append(np.linalg.lstsq(left, right, rcond=None)[0].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("utt"), pa.array(out, pa.list_(pa.float64()))], names=["utt", "vec"])


def ivector(statistics: DataFrame, total: np.ndarray, model: Mixture) -> DataFrame:
    """(utt, vec): least-squares factors of the centred statistics under the total-variability matrix ((M D) x R)."""
    lists = F.array_sort(F.collect_list(F.struct("mix", "ec", "f")))
    packed = statistics.groupBy("utt").agg(lists.alias("s")).select("utt", F.transform("s", lambda x: x["ec"]).alias("ec"), F.transform("s", lambda x: x["f"]).alias("f"))
    return packed.mapInArrow(partial(_solve, total=total, model=model), "utt long, vec array<double>")


def _packed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (name, vector) as few rows of many: names, and their vectors one after another, `VALUES` numbers at most."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            width = max(1, len(batch.column(1)[start]))
            own = batch.slice(start, max(1, VALUES // width))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([whole(own.column(0)), whole(own.column(1).flatten())], names=names)
            start += own.num_rows


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            models, own, tests, x = (batch.column(c)[k].values for c in ("models", "own", "tests", "x"))
            m, n = len(models), len(tests)
            scores = x.to_numpy().reshape(n, -1) @ own.to_numpy().reshape(m, -1).T
            for a in range(0, n, max(1, 100_000 // m)):
                b = min(n, a + max(1, 100_000 // m))
                names = models.take(pa.array(np.tile(np.arange(m), b - a)))
                yield pa.RecordBatch.from_arrays([names, tests.take(pa.array(np.repeat(np.arange(a, b), m))), pa.array(scores[a:b].ravel())], names=["model", "test", "score"])


def trials(enrolled: DataFrame, tests: DataFrame) -> DataFrame:
    """(model, test, score): inner products of every test (test, vec) with the enrolled models (model, model_vec).

    The models are a stated set. Both sides are packed into rows of at most `VALUES` numbers, and each pair of such rows is
    one matrix product in a task; nothing of either passes through the driver. No models give no rows.
    """
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    model, test = kind(enrolled, "model"), kind(tests, "test")
    own = enrolled.select("model", F.col("model_vec").cast("array<double>").alias("v"))
    rows = tests.select("test", F.col("vec").cast("array<double>").alias("vec"))
    own = own.mapInArrow(partial(_packed, names=["models", "own"]), f"models array<{model}>, own array<double>")
    rows = rows.mapInArrow(partial(_packed, names=["tests", "x"]), f"tests array<{test}>, x array<double>")
    return rows.crossJoin(own).mapInArrow(_products, f"model {model}, test {test}, score double")


def normalised(scores: DataFrame, cohort: DataFrame, by: str) -> DataFrame:
    """Scores in deviations from the mean of the cohort's scores with the same model (z-norm) or test (t-norm)."""
    stats = cohort.groupBy(by).agg(F.avg("score").alias("_m"), F.greatest(F.stddev_pop("score"), F.lit(1e-9)).alias("_s"))
    return scores.join(stats, by).withColumn("score", (F.col("score") - F.col("_m")) / F.col("_s")).drop("_m", "_s")
