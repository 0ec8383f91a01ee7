"""Operators on feature frames: tables of (utt, frame, base, ...), one block of features for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import clamped, own_rows, with_halo

#: Fixed values of RASTA: the pole, and taps on this frame and the four before; the output is two frames early.
POLE, TAPS = 0.98, (0.2, 0.1, 0.0, -0.1, -0.2)
#: Frames of a block of the recursion, and the blocks that a block's state reaches.
PART, REACH = 256, 8
BLOCKS = {"f": "base", "d": "delta", "a": "accel", "e": "energy", "s": "sdc"}


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _windowed(frames: DataFrame, reach: int, name: str, value: Column) -> DataFrame:
    columns = [c for c in frames.columns if c != name]
    return own_rows(with_halo(frames.select(columns), "frame", reach, reach).withColumn(name, value)).select(*columns, name)


def regression(frames: DataFrame, reach: int, source: str = "base", name: str = "delta") -> DataFrame:
    """Slope of each feature over 2 * reach + 1 frames; frames beyond the ends repeat the first or last.

    With source `delta` and name `accel` it is the acceleration.
    """
    if source not in frames.columns:
        raise ValueError(f"{name} needs the block {source}")
    c = F.col(source)
    parts = [_scaled(_minus(clamped(c, k, "frame", "utt"), clamped(c, -k, "frame", "utt")), float(k)) for k in range(1, reach + 1)]
    norm = float(sum(2 * k * k for k in range(1, reach + 1)))
    return _windowed(frames, reach, name, F.transform(reduce(_plus, parts), lambda v: v / norm))


def _scaled(x: Column, factor: float) -> Column:
    return F.transform(x, lambda v: v * factor)


def difference(frames: DataFrame, reach: int, name: str = "delta") -> DataFrame:
    """Each feature `reach` frames on less `reach` frames back."""
    c = F.col("base")
    return _windowed(frames, reach, name, _minus(clamped(c, reach, "frame", "utt"), clamped(c, -reach, "frame", "utt")))


def shifted_deltas(frames: DataFrame, spacing: int, blocks: int) -> DataFrame:
    """`sdc`: the delta blocks of frames `spacing` apart, around each frame, one after another."""
    if "delta" not in frames.columns:
        raise ValueError("shifted deltas need the block delta")
    half = blocks // 2
    shifts = range(-half, half + 1) if blocks % 2 else range(-half, half)
    c = F.col("delta")
    return _windowed(frames, spacing * half, "sdc", F.concat(*[clamped(c, j * spacing, "frame", "utt") for j in shifts]))


def rasta(frames: DataFrame, name: str = "base") -> DataFrame:
    """Band-pass each feature along time: y[t] = 0.98 y[t - 1] + the sum of `TAPS` over frames t + 2 to t - 2.

    Frames beyond the ends repeat the first or last. Inside a block of frames the recursion is a running sum
    of scaled terms; a block starts from what the blocks before it leave over, which after `REACH` blocks has
    decayed below a double's precision. So no task needs an utterance whole.
    """
    x = F.col("v")
    longer = with_halo(frames.select("utt", "frame", F.posexplode(name).alias("d", "v")), "frame", 2, 2)
    driven = reduce(lambda a, b: a + b, [clamped(x, 2 - k, "frame", "utt", "d") * t for k, t in enumerate(TAPS) if t])
    # Before frame 0 the recursion has seen the taps on the repeated first frame, and once the second.
    early = (clamped(x, 1, "frame", "utt", "d") - x) * TAPS[0]
    rows = own_rows(longer.withColumns({"u": driven, "early": early})).select("utt", "d", "frame", "u", "early")
    rows = rows.withColumns({"part": F.floor(F.col("frame") / PART), "at": F.col("frame") % PART})
    left = rows.groupBy("utt", "d", "part").agg(F.sum(F.col("u") * F.pow(F.lit(POLE), PART - 1 - F.col("at"))).alias("left"))
    first = rows.where("frame = 0").select("utt", "d", F.lit(-1).cast("long").alias("part"), F.col("early").alias("left"))
    later = F.explode(F.transform(F.sequence(F.lit(1), F.lit(REACH)), lambda k: F.struct((F.col("part") + k).alias("part"), (F.col("left") * F.pow(F.lit(POLE), PART * (k - 1))).alias("carry"))))
    carry = left.unionByName(first).select("utt", "d", later.alias("c")).groupBy("utt", "d", "c.part").agg(F.sum("c.carry").alias("carry"))
    w = Window.partitionBy("utt", "d", "part").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.pow(F.lit(POLE), "at") * F.sum(F.col("u") / F.pow(F.lit(POLE), "at")).over(w)
    done = rows.withColumn("own", own).join(carry, ["utt", "d", "part"], "left")
    done = done.withColumn("v", F.col("own") + F.coalesce("carry", F.lit(0.0)) * F.pow(F.lit(POLE), F.col("at") + 1))
    new = done.groupBy("utt", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias(name))
    return frames.drop(name).join(new, ["utt", "frame"])


def normalise(frames: DataFrame, *names: str) -> DataFrame:
    """Zero mean and unit population variance of each feature over its utterance; the deviation is 1e-6 at least."""
    out = frames
    for name in names or ("base",):
        stats = frames.select("utt", F.posexplode(name).alias("d", "v")).groupBy("utt", "d").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("s"))
        packed = stats.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("_stats"))
        scaled = F.zip_with(name, "_stats", lambda v, p: (v - p["m"]) / p["s"])
        out = out.join(packed, "utt").withColumn(name, scaled).drop("_stats")
    return out


def select_features(frames: DataFrame, which: str) -> DataFrame:
    """`features`: the blocks that the letters name, in their order; `all` is every block but the energy."""
    letters = [k for k in "fdas" if BLOCKS[k] in frames.columns] if which == "all" else list(which)
    for k in letters:
        if k not in BLOCKS or BLOCKS[k] not in frames.columns:
            raise ValueError(f"there is no block {k!r}")
    parts = [F.array(F.col("energy")) if k == "e" else F.col(BLOCKS[k]) for k in letters]
    return frames.withColumn("features", F.concat(*parts))


def transposed(frames: DataFrame, start: int, stop: int, name: str = "features") -> DataFrame:
    """(utt, d, values): the frames from start to stop of each utterance with their dimensions as rows. The slice is a caller's, so it is bounded."""
    rows = frames.where((F.col("frame") >= start) & (F.col("frame") < stop)).select("utt", "frame", F.posexplode(name).alias("d", "v"))
    return rows.groupBy("utt", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda x: x["v"]).alias("values"))


def apply_sad(frames: DataFrame) -> DataFrame:
    """Speech frames only, numbered anew; applying it again changes nothing.

    A frame's new number is the count of speech frames before it: counts for blocks of frames are summed
    over the blocks, and the order inside a block is added, so no task sorts a whole utterance.
    """
    size = 65_536
    speech = frames.where("sad = 1").withColumn("block", F.floor(F.col("frame") / size))
    per = speech.groupBy("utt", "block").count()
    before = per.withColumn("base_n", F.coalesce(F.sum("count").over(Window.partitionBy("utt").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("utt", "block").orderBy("frame")) - 1
    numbered = speech.withColumn("_own", own).join(before.select("utt", "block", "base_n"), ["utt", "block"])
    return numbered.withColumn("frame", F.col("base_n") + F.col("_own")).drop("block", "base_n", "_own")
