"""Interval algebra on tables of (utt, start, stop, label): runs, merging, difference, intersection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import over, own_rows, with_halo


def runs(frames: DataFrame, label: str = "label") -> DataFrame:
    """(utt, start, stop, label): maximal runs of frames with one label, stop exclusive.

    Starts and stops are found among neighbouring frames; only they are paired in order, as many as there
    are runs.
    """
    near = with_halo(frames.select("utt", "frame", F.col(label).alias("label")), "frame", 1, 1)
    w = over("frame", "utt")
    own = F.col("label")
    marked = own_rows(near.withColumns({"first": ~own.eqNullSafe(F.lag("label").over(w)) | F.lag("frame").over(w).isNull(), "last": ~own.eqNullSafe(F.lead("label").over(w)) | F.lead("frame").over(w).isNull()}))
    edges = marked.where(F.col("first") | F.col("last"))
    paired = edges.withColumn("stop", F.when(F.col("last"), F.col("frame")).otherwise(F.lead("frame").over(Window.partitionBy("utt").orderBy("frame"))) + 1)
    return paired.where("first").select("utt", F.col("frame").alias("start"), "stop", "label")


def merged(intervals: DataFrame, gap: float, shortest: float) -> DataFrame:
    """Intervals of an utterance joined over gaps below `gap`; those below `shortest` are dropped afterwards."""
    w = Window.partitionBy("utt").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - before < gap, 0).otherwise(1)
    grouped = intervals.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("utt", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")
    return out.where(F.col("stop") - F.col("start") >= shortest)


def coalesced(intervals: DataFrame) -> DataFrame:
    """Intervals of one label that touch become one."""
    w = Window.partitionBy("utt").orderBy("start")
    new = F.when((F.lag("stop").over(w) == F.col("start")) & F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)
    grouped = intervals.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("utt", "_g", "label").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g").select("utt", "start", "stop", "label")


def _swept(first: DataFrame, second: DataFrame, wanted: Column) -> DataFrame:
    """The stretches of an utterance where `wanted` holds of a and b, the numbers of intervals that cover it."""
    ends = lambda d, a, b: d.select("utt", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("stop").alias("t"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))).alias("e"))
    points = ends(first, 1, 0).unionByName(ends(second, 0, 1)).groupBy("utt", "e.t").agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    w = Window.partitionBy("utt").orderBy("t")
    cover = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select("utt", F.col("t").alias("start"), F.lead("t").over(w).alias("stop"), F.sum("a").over(cover).alias("a"), F.sum("b").over(cover).alias("b"))
    return coalesced(pieces.where(wanted & F.col("stop").isNotNull()).select("utt", "start", "stop", F.lit(1).alias("label"))).select("utt", "start", "stop")


def subtract(first: DataFrame, second: DataFrame) -> DataFrame:
    """What of the first intervals no second one covers."""
    return _swept(first, second, (F.col("a") > 0) & (F.col("b") == 0))


def intersect(first: DataFrame, second: DataFrame) -> DataFrame:
    """What both cover."""
    return _swept(first, second, (F.col("a") > 0) & (F.col("b") > 0))
