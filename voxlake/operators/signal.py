"""Operators on signals: tables of (utt, i, x), one row for each sample.

Indices run from 0 without gaps. Whatever sums over neighbours works on blocks of consecutive samples as arrays
(`by_block`): each sample is shuffled once, with copies of the few around a block, whatever the number of taps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SIZE, by_block, over, own_rows, with_halo

PEAK = 32_767.0


def per_utterance(signal: DataFrame, *aggregates: Column) -> DataFrame:
    """`signal` with aggregates of its utterance: a partial sum for each task, then a join of small rows."""
    return signal.join(signal.groupBy("utt").agg(*aggregates), "utt")


def normalize(signal: DataFrame) -> DataFrame:
    """Scale each utterance to a largest magnitude of 32,767; silence stays."""
    peak = F.when(F.max(F.abs("x")) > 0, F.max(F.abs("x"))).otherwise(1.0).alias("peak")
    return per_utterance(signal, peak).select("utt", "i", (F.col("x") * PEAK / F.col("peak")).alias("x"))


def means(signal: DataFrame, size: int = SIZE) -> DataFrame:
    """(utt, mean) with samples added in their order, inside blocks and then over blocks, so that its last bit doesn't depend on where the rows lie."""
    own = signal.select("utt", "i", F.col("x").cast("double").alias("x"), F.floor(F.col("i") / size).alias("block"))
    run = F.sum("x").over(over("i", "utt").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = own.withColumn("run", run).groupBy("utt", "block").agg(F.max_by("run", "i").alias("sum"), F.count("x").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("block", "sum")))
    total = F.aggregate(listed, F.lit(0.0), lambda a, b: a + F.coalesce(b["sum"], F.lit(0.0)))
    return blocks.groupBy("utt").agg((total / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))


def remove_mean(signal: DataFrame) -> DataFrame:
    return signal.join(means(signal), "utt").select("utt", "i", (F.col("x") - F.col("mean")).alias("x"))


def preemphasis(signal: DataFrame, a: float) -> DataFrame:
    """x[i] - a * x[i - 1]; nothing comes before the first sample."""
    before = F.coalesce(F.lag("x").over(over("i", "utt")), F.lit(0.0))
    return own_rows(with_halo(signal, "i", 1, 0).withColumn("x", F.col("x") - F.lit(a) * before)).select("utt", "i", "x")


def _dense(i: np.ndarray, x: np.ndarray, pad: int = 0) -> np.ndarray:
    """Samples at their places from the first on, with zeros around them."""
    out = np.zeros(int(i[-1] - i[0]) + 1 + 2 * pad)
    out[i - i[0] + pad] = x
    return out


def _convolved(i: np.ndarray, x: np.ndarray, start: int, size: int, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs from the block's start to its end, or to the last that a tap reaches."""
    low, high = int(i[0]), int(i[-1])
    at = np.arange(max(start, low), min(start + size, high + len(taps)))
    return at, np.convolve(_dense(i, x), taps)[at - low]


def fir(signal: DataFrame, taps: Sequence[float], stride: int = 1) -> DataFrame:
    """Full convolution with taps that lie `stride` samples apart: n + (taps - 1) * stride samples."""
    spaced = np.zeros((len(taps) - 1) * stride + 1)
    spaced[::stride] = taps
    return by_block(signal, len(spaced) - 1, 0, partial(_convolved, taps=spaced))


def complementary_ifir(signal: DataFrame, first: Sequence[float], stride: int, second: Sequence[float]) -> DataFrame:
    """The delayed signal less its cascade of two filters, the first with taps `stride` apart; the delay must be even."""
    delay = (len(first) - 1) * stride + len(second) - 1
    if delay % 2:
        raise ValueError("the filters' total delay must be even")
    low = fir(fir(signal, first, stride), second).withColumn("x", -F.col("x"))
    late = signal.select("utt", (F.col("i") + delay // 2).cast("long").alias("i"), "x")
    return low.unionByName(late).groupBy("utt", "i").agg(F.sum("x").alias("x"))


def fir_zero_phase(signal: DataFrame, taps: Sequence[float]) -> DataFrame:
    """A symmetric filter of odd length without delay; the length stays."""
    if len(taps) % 2 == 0:
        raise ValueError("a zero-phase filter has an odd number of taps")
    return fir_up_down(signal, taps, 1, 1, len(taps) // 2)


def _stepped(i: np.ndarray, x: np.ndarray, start: int, size: int, taps: np.ndarray, up: int, down: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs whose place among the samples, down * j / up, lies in the block and not past the signal's end."""
    own = i[(i >= start) & (i < start + size)]
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0)
    stop = min(((int(own[-1]) + 1) * up - 1) // down, int(i[-1]) * up // down)
    j = np.arange(-(-start * up // down), stop + 1)
    reach = -(-len(taps) // up)
    h = np.zeros(reach * up)
    h[: len(taps)] = taps
    last = (down * j + offset) // up
    phase = down * j + offset - up * last
    pad = reach + abs(offset) // up + 2
    padded = _dense(i, x, pad)
    y = np.zeros(len(j))
    for m in range(reach):
        y += h[phase + up * m] * padded[last - m - int(i[0]) + pad]
    return j, y


def fir_up_down(signal: DataFrame, taps: Sequence[float], up: int, down: int, offset: int = 0) -> DataFrame:
    """Change the rate by up / down: y[j] = sum of x[i] * h[down * j - up * i + offset], j up to up * (n - 1) / down."""
    before = max(0, -(-(len(taps) - 1 - offset) // up)) + 1
    run = partial(_stepped, taps=np.array(taps, float), up=up, down=down, offset=offset)
    return by_block(signal, before, max(offset, 0) // up + 2, run)


#: Steps from a rate to 8 and to 16 kHz, as (up, down).
TO_8K = {8000: (1, 1), 16000: (1, 2), 32000: (1, 4), 48000: (1, 6), 11025: (320, 441), 22050: (160, 441), 44100: (80, 441)}
TO_16K = {16000: (1, 1), 32000: (1, 2), 48000: (1, 3), 22050: (320, 441), 44100: (160, 441)}


def low_pass(up: int, down: int, lobes: int = 8) -> list[float]:
    """A Hann-windowed sinc at the lower of the two rates' half, for the raised rate; odd and symmetric."""
    wide = max(up, down)
    half = lobes * wide
    taps = []
    for k in range(-half, half + 1):
        x = k / wide
        sinc = 1.0 if k == 0 else math.sin(math.pi * x) / (math.pi * x)
        taps.append(sinc * (0.5 + 0.5 * math.cos(math.pi * k / (half + 1))) * up / wide)
    return taps


def resample(signal: DataFrame, rate: int, steps: dict[int, tuple[int, int]] = TO_8K) -> DataFrame:
    """The signal at the target rate of `steps`, without delay; rates that have no step are an error."""
    if rate not in steps:
        raise ValueError(f"no way to resample from {rate} Hz")
    up, down = steps[rate]
    if up == down:
        return signal.select("utt", "i", "x")
    taps = low_pass(up, down)
    return fir_up_down(signal, taps, up, down, len(taps) // 2)


def quantize(signal: DataFrame, scale: bool = False, clip: bool = False, truncate: bool = False) -> DataFrame:
    """16-bit samples: scaled to the peak or clipped, truncated toward zero or rounded half away from it."""
    if not (scale or clip):
        raise ValueError("either scale or clip is needed, or samples may not fit")
    own = normalize(signal) if scale else signal
    x = F.col("x")
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) if truncate else F.signum(x) * F.floor(F.abs(x) + 0.5)
    return own.select("utt", "i", F.greatest(F.lit(-32768), F.least(F.lit(32767), whole)).cast("int").alias("x"))


def sliced(signal: DataFrame, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """Samples of a slice with the usual meaning of negative bounds and steps, numbered anew."""
    if step == 0:
        raise ValueError("a slice's step can't be 0")
    n = F.col("n")
    clip = lambda v, low, high: F.greatest(low, F.least(v, high))
    bound = lambda v: F.lit(v) if v >= 0 else n + v
    if step > 0:
        a = F.lit(0) if start is None else clip(bound(start), F.lit(0), n)
        b = n if stop is None else clip(bound(stop), F.lit(0), n)
        inside = (F.col("i") >= a) & (F.col("i") < b)
    else:
        a = n - 1 if start is None else clip(bound(start), F.lit(-1), n - 1)
        b = F.lit(-1) if stop is None else clip(bound(stop), F.lit(-1), n - 1)
        inside = (F.col("i") <= a) & (F.col("i") > b)
    own = per_utterance(signal, (F.max("i") + 1).alias("n"))
    new = ((F.col("i") - a) / step).cast("long")
    return own.where(inside & ((F.col("i") - a) % abs(step) == 0)).select("utt", new.alias("i"), "x")


def assigned(signal: DataFrame, updates: DataFrame) -> DataFrame:
    """The signal with the values of `updates` (utt, i, x) in place of its own."""
    new = updates.select("utt", "i", F.col("x").alias("new"))
    return signal.join(new, ["utt", "i"], "left").select("utt", "i", F.coalesce("new", "x").alias("x"))
