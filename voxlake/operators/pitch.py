"""Pitch by normalised cross-correlation of frames and the cheapest path through their peaks.

The columns below show each step as an expression over arrays. `candidates` makes them for batches of frames, wherever
these are; only `paths` takes an utterance's frames in order (see `lattice`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import Candidates, Costs, Lattice
from .spectral import framed


@dataclass(frozen=True)
class PitchConfig:
    """Costs and limits of the search; frequencies in Hz, times in seconds."""

    low: float = 60.0
    high: float = 400.0
    window: float = 0.0075
    step: float = 0.01
    cand_thresh: float = 0.3
    lag_weight: float = 0.3
    freq_weight: float = 0.02
    trans_cost: float = 0.005
    trans_amp: float = 0.5
    trans_spec: float = 0.5
    voice_bias: float = 0.0
    double_cost: float = 0.35
    n_cands: int = 20
    #: Whether peaks are first looked for at a lower rate.
    coarse: bool = True

    def validate(self, rate: float) -> None:
        if not rate / 10_000 <= self.low < self.high < rate / 2:
            raise ValueError("pitch limits must lie between a ten-thousandth and half of the sampling rate")
        if not (1 / rate <= self.step <= 0.1 and 0.0001 <= self.window <= 0.1):
            raise ValueError("step and window must be at most 0.1 s and not below a sample and 0.1 ms")
        if not (0.01 <= self.cand_thresh <= 0.99 and 3 <= self.n_cands <= 100):
            raise ValueError("the threshold must lie between 0.01 and 0.99, the number of candidates between 3 and 100")


def correlation(x: Column, size: int, lag: Column) -> Column:
    """Normalised product of the first `size` samples with those `lag` later, less the first ones' mean."""
    part = lambda start: F.slice(x, start, F.lit(size))
    mean = F.aggregate(part(F.lit(1)), F.lit(0.0), lambda a, v: a + v) / size
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, v: s + v)
    first, later = part(F.lit(1)), part(lag + 1)
    return dot(first, later) / F.sqrt(dot(first, first) * dot(later, later) + 1e-12)


def peaks(c: Column, threshold: float) -> Column:
    """Positions of values that no neighbour exceeds and that reach a share of the largest; plateaus count."""
    at = F.sequence(F.lit(1), F.size(c) - 2)
    top = F.array_max(c) * threshold
    return F.filter(at, lambda k: (F.get(c, k) >= F.get(c, k - 1)) & (F.get(c, k) >= F.get(c, k + 1)) & (F.get(c, k) > top))


def refined(c: Column, k: Column) -> Column:
    """(place, height) of the parabola through a peak and its neighbours."""
    left, mid, right = F.get(c, k - 1), F.get(c, k), F.get(c, k + 1)
    bend = (left + right) / 2 - mid
    slope = (right - left) / 2
    shift = F.when(F.abs(bend) > 1e-9, -slope / (2 * bend)).otherwise(0.0)
    return F.struct((k + shift).alias("place"), (mid + slope * shift / 2).alias("height"))


def itakura(autocorrelation: Column, coefficients: Column, gain: Column) -> Column:
    """Ratio of the error that a predictor leaves in a frame to the gain of the frame's own."""
    return F.aggregate(F.zip_with(autocorrelation, coefficients, lambda r, a: r * a), F.lit(0.0), lambda s, v: s + v) / gain


def autocorrelation(x: Column, size: int, order: int, stability: float = 30.0) -> Column:
    """Products of `size` samples with themselves 0 to `order` later; those above 0 shrink by a stability factor in dB."""
    shrink = 1 / (1 + 10 ** (-stability / 20))

    def at(d: Column) -> Column:
        products = F.zip_with(F.slice(x, F.lit(1), F.lit(size) - d), F.slice(x, d + 1, F.lit(size) - d), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda a, v: a + v) * F.when(d > 0, shrink).otherwise(1.0)

    return F.transform(F.sequence(F.lit(0), F.lit(order)), at)


def predictor(r: Column, order: int) -> Column:
    """(a, gain) by the Levinson-Durbin recursion: coefficients, the first of which is 1, and the error that they leave.

    A silent frame's other coefficients and its gain are 0.
    """
    zero = F.array(F.lit(0.0))

    def longer(s: Column, i: Column) -> Column:
        missed = F.aggregate(F.zip_with(s["a"], F.reverse(F.slice(r, F.lit(2), i)), lambda a, v: a * v), F.lit(0.0), lambda a, v: a + v)
        reflection = F.when(s["gain"] > 0, -missed / s["gain"]).otherwise(0.0)
        mixed = lambda k: F.zip_with(F.concat(s["a"], zero), F.concat(zero, F.reverse(s["a"])), lambda a, b: a + k * b)
        bound = F.transform(F.array(reflection), lambda k: F.struct(mixed(k).alias("a"), (s["gain"] * (1 - k * k)).alias("gain")))
        return F.get(bound, 0)

    first = F.struct(F.array(F.lit(1.0)).alias("a"), F.get(r, 0).alias("gain"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), first, longer)


def predictor_products(a: Column, order: int) -> Column:
    """What `itakura` multiplies a frame's autocorrelation with: products of coefficients, those off the diagonal twice."""

    def at(d: Column) -> Column:
        products = F.zip_with(F.slice(a, F.lit(1), F.lit(order + 1) - d), F.slice(a, d + 1, F.lit(order + 1) - d), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) * F.when(d > 0, 2.0).otherwise(1.0)

    return F.transform(F.sequence(F.lit(0), F.lit(order)), at)


def stationarity(frames: DataFrame, size: int, apart: int, order: int) -> DataFrame:
    """`frames` (utt, frame, x) with `stationarity` and `rms_ratio` between the first `size` samples of each and those `apart` later.

    Frames have size + apart samples, so neighbours need no shuffle. Stationarity is 0.2 / (Itakura distance - 0.8), 1 where
    the earlier window predicts the later one as well as its own coefficients; 0 where either is silent, as is the ratio.
    """
    later = F.slice("x", apart + 1, size)
    both = frames.withColumn("before", predictor(autocorrelation(F.col("x"), size, order), order))
    both = both.withColumn("r", autocorrelation(later, size, order)).withColumn("after", predictor(F.col("r"), order))
    both = both.withColumn("was", windowed_rms(F.col("x"), size)).withColumn("now", windowed_rms(later, size))
    heard = (F.col("before.gain") > 0) & (F.col("after.gain") > 0)
    distance = itakura(F.col("r"), predictor_products(F.col("before.a"), order), F.when(heard, F.col("after.gain")))
    return both.select(
        "utt",
        "frame",
        F.coalesce(F.lit(0.2) / (distance - 0.8), F.lit(0.0)).alias("stationarity"),
        F.when(heard & (F.col("was") > 0), F.col("now") / F.col("was")).otherwise(0.0).alias("rms_ratio"),
    )


def windowed_rms(x: Column, size: int) -> Column:
    """Root of the mean square under a Hann window."""
    w = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * (k + 0.5) / size)) for k in range(size)])
    return F.sqrt(F.aggregate(F.zip_with(F.slice(x, 1, size), w, lambda v, h: v * h * v * h), F.lit(0.0), lambda s, v: s + v) / size)


#: Seconds of the windows that are compared for stationarity, and between them; pre-emphasis; stability in dB.
STAT_WINDOW, STAT_APART, STAT_EMPHASIS, STAT_STABILITY = 0.030, 0.020, 0.4, 30.0
#: Samples a second that the coarse search has about, seconds of its filter, and lags around a coarse peak that are looked at.
COARSE_RATE, FILTER_SECONDS, PATCH = 2000.0, 0.005, 7
#: What is added to the product of energies around a coarse peak, and the least energy, of samples in 16-bit units.
REGULARISER, LEAST_ENERGY = 10_000.0, 1.0


def window(kind: str, n: int) -> np.ndarray:
    """A window of n points: rectangular, hamming, hann, or cos4 (the fourth power of hann)."""
    turn = 2 * np.pi * (np.arange(n) + 0.5) / n
    hann = 0.5 - 0.5 * np.cos(turn)
    shapes = {"rectangular": np.ones(n), "hamming": 0.54 - 0.46 * np.cos(turn), "hann": hann, "cos4": hann**4}
    if kind not in shapes:
        raise ValueError(f"no window is called {kind}")
    return shapes[kind]


def windowed(x: Column, size: int, kind: str, preemphasis: float = 0.0) -> Column:
    """The first samples of a frame under a window; with pre-emphasis each less a share of the one before, so size + 1 are read."""
    w = F.array(*[F.lit(float(v)) for v in window(kind, size)])
    own = F.slice(x, 1, size)
    if preemphasis:
        own = F.zip_with(F.slice(x, 2, size), own, lambda now, was: now - preemphasis * was)
    return F.zip_with(own, w, lambda v, h: v * h)


@dataclass(frozen=True)
class Search:
    """Sizes in samples that follow from a rate and a configuration."""

    rate: float
    config: PitchConfig

    def __post_init__(self):
        c = self.config
        c.validate(self.rate)
        nearest = lambda v: int(v + 0.5)
        sizes = {"step": nearest(c.step * self.rate), "size": nearest(c.window * self.rate), "start": nearest(self.rate / c.high), "stop": nearest(self.rate / c.low)}
        sizes["lags"] = sizes["stop"] - sizes["start"] + 1
        sizes["every"] = max(1, int(self.rate / COARSE_RATE)) if c.coarse else 1
        sizes["taps"] = int(self.rate * FILTER_SECONDS) | 1
        sizes["stat"], sizes["apart"] = int(self.rate * STAT_WINDOW), int(self.rate * STAT_APART)
        sizes["order"] = int(2 + self.rate / 1000)
        for name, value in sizes.items():
            object.__setattr__(self, name, value)
        # A frame's row begins so many samples before the frame.
        back = max(self.taps // 2 if self.every > 1 else 0, self.apart + (self.stat - self.apart) // 2 + 1)
        object.__setattr__(self, "back", back)
        object.__setattr__(self, "ahead", max(self.size + self.stop + 1 + PATCH + (self.taps // 2 + 2 * self.every if self.every > 1 else 0), self.stat + self.apart))

    @property
    def costs(self) -> Costs:
        c = self.config
        return Costs(c.lag_weight / self.stop, c.freq_weight * self.rate / self.step, c.double_cost, c.trans_cost, c.trans_spec, c.trans_amp, c.voice_bias)


def low_pass(every: int, taps: int) -> np.ndarray:
    """A Hann-windowed sinc that lets half of the rate after decimation through."""
    k = np.arange(taps) - taps // 2
    return np.sinc(k / every) / every * window("hann", taps)


def lagged(x: np.ndarray, size: int, start: int, lags: int) -> np.ndarray:
    """Correlation of each row's first `size` samples with those `start` to start + lags - 1 later, less the first ones' mean."""
    y = x - x[:, :size].mean(1, keepdims=True)
    first = y[:, :size]
    energy = np.einsum("ij,ij->i", first, first)
    run = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, axis=1)], axis=1)
    out = np.zeros((len(y), lags))
    for k in range(lags):
        at = start + k
        later = np.maximum(run[:, at + size] - run[:, at], LEAST_ENERGY)
        out[:, k] = np.einsum("ij,ij->i", first, y[:, at : at + size]) / np.sqrt(np.where(energy > 0, later * energy, 1))
    return out


def picked(c: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a value is a peak: above a share of the row's largest positive one, and below no neighbour (plateaus count)."""
    out = np.zeros(c.shape, bool)
    top = np.maximum(c.max(1, initial=0), 0)[:, None] * threshold
    inner = c[:, 1:-1]
    out[:, 1:-1] = (inner > top) & (inner >= c[:, :-2]) & (inner >= c[:, 2:])
    out[:, -2:] = False
    return out


def best(row: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Where the `most` largest values of each row are, in the order in which they stand; `row` is sorted."""
    order = np.lexsort((-value, row))
    rank = np.arange(len(order)) - np.searchsorted(row, row[order])
    return np.sort(order[rank < most])


def parabola(left: np.ndarray, mid: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift, height) of the parabola through three values."""
    bend = (left + right) / 2 - mid
    shift = np.where(np.abs(bend) > 1e-6, (left - right) / (4 * np.where(np.abs(bend) > 1e-6, bend, 1)), 0)
    return shift, mid - bend * shift**2


def _around(x: np.ndarray, size: int, row: np.ndarray, lag: np.ndarray, plan: Search) -> np.ndarray:
    """Full-rate correlations in patches around lags; 0 where none is looked at, which a peak at a patch's border has as its neighbour."""
    y = x - x[:, :size].mean(1, keepdims=True)
    energy = np.einsum("ij,ij->i", y[:, :size], y[:, :size])
    run = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, axis=1)], axis=1)
    out = np.zeros((len(y), plan.lags))
    start = np.maximum(lag - PATCH // 2, plan.start)
    wanted = np.zeros(out.shape, bool)
    for k in range(PATCH):
        at = start + k - plan.start
        inside = at < plan.lags
        wanted[row[inside], at[inside]] = True
    row, at = np.nonzero(wanted)
    view = np.lib.stride_tricks.sliding_window_view(y, size, axis=1)
    for a in range(0, len(row), 16_384):
        r, g = row[a : a + 16_384], at[a : a + 16_384] + plan.start
        later = np.maximum(run[r, g + size] - run[r, g], LEAST_ENERGY)
        out[r, at[a : a + 16_384]] = np.einsum("ij,ij->i", y[r, :size], view[r, g]) / np.sqrt(REGULARISER + later * energy[r])
    out[energy <= 0] = 0
    return out


def _levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictors (the first coefficient is 1) and errors of rows of autocorrelations."""
    a, error = np.zeros_like(r), r[:, 0].copy()
    a[:, 0] = 1
    for i in range(1, r.shape[1]):
        k = -np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1]) / error
        a[:, 1 : i + 1] = a[:, 1 : i + 1] + k[:, None] * a[:, i - 1 :: -1]
        error = error * (1 - k * k)
    return a, error


def _compared(x: np.ndarray, plan: Search, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stationarity, ratio of RMS and RMS of frames: windows that meet in the frame's middle; `known` counts samples before the frame."""
    size, order = plan.stat, plan.order
    ind = -((size - plan.apart) // 2)
    now, was = (x[:, plan.back + at : plan.back + at + size] for at in (ind, ind - plan.apart))
    shape = window("hann", size - 1)
    stable = 1 / (1 + 10 ** (-STAT_STABILITY / 20))

    def statistics(part: np.ndarray) -> np.ndarray:
        y = shape * (part[:, 1:] - STAT_EMPHASIS * part[:, :-1])
        r = np.stack([np.einsum("ij,ij->i", y[:, : y.shape[1] - d], y[:, d:]) for d in range(order + 1)], axis=1)
        power = r[:, :1].copy()
        r = np.where(power > 0, r / np.where(power > 0, power, 1), 0)
        r[:, 1:] *= stable
        r[:, 0] = 1
        return r

    rms = lambda part: np.sqrt(((window("hann", size) * part) ** 2).mean(1))
    r_now, r_was = statistics(now), statistics(was)
    a, _ = _levinson(r_now)
    _, error = _levinson(r_was)
    products = np.stack([np.einsum("ij,ij->i", a[:, : order + 1 - d], a[:, d:]) * (2 if d else 1) for d in range(order + 1)], axis=1)
    distance = np.einsum("ij,ij->i", products, r_was) / error
    loud, before = rms(now), rms(was)
    ratio = np.where(before > 0, (0.001 + loud) / np.where(before > 0, before, 1), np.where(loud > 0, 2.0, 1.0))
    stationary = 0.2 / np.maximum(distance - 0.8, 0.2)
    # At the start there is nothing to compare with.
    stationary = np.where(known >= plan.apart - ind, stationary, np.where(known >= -ind, 0.02, 0.002))
    return stationary, np.where(known >= plan.apart - ind, ratio, 1.0), np.where(known >= -ind, loud, 0.0)


def search(x: np.ndarray, known: np.ndarray, plan: Search) -> tuple[np.ndarray, ...]:
    """(row, lag, place, peak) of the candidates of frames, sorted by row and lag, then (top, stationarity, rms_ratio, rms) by row.

    Each row of x holds a frame's samples from `plan.back` before it on. With decimation, coarse peaks are
    found at about 2 kHz and correlations at the full rate are made only around them.
    """
    own, most, limit = x[:, plan.back :], plan.config.n_cands - 1, plan.config.cand_thresh
    if plan.every > 1:
        start, lags, size = max(1, plan.start // plan.every), 1 + plan.lags // plan.every, 1 + plan.size // plan.every
        half = plan.taps // 2
        view = np.lib.stride_tricks.sliding_window_view(x[:, plan.back - half :], plan.taps, axis=1)[:, :: plan.every]
        c = lagged(view[:, : size + start + lags] @ low_pass(plan.every, plan.taps), size, start, lags)
        row, at = np.nonzero(picked(c, limit))
        shift, height = parabola(c[row, at - 1], c[row, at], c[row, at + 1])
        lag = (at + start) * plan.every + np.trunc(0.5 + shift * plan.every).astype(np.int64)
        chosen = best(row, height * (1 - plan.config.lag_weight / plan.lags * lag), most)
        c = _around(own, plan.size, row[chosen], lag[chosen], plan)
    else:
        c = lagged(own, plan.size, plan.start, plan.lags)
    row, at = np.nonzero(picked(c, limit))
    chosen = best(row, c[row, at], most)
    row, at = row[chosen], at[chosen]
    shift, _ = parabola(c[row, at - 1], c[row, at], c[row, at + 1])
    return row, at + plan.start, at + plan.start + shift, c[row, at], np.maximum(c.max(1, initial=0), 0), *_compared(x, plan, known)


#: The columns of candidates; lists are sorted by lag.
FOUND = "lags array<double>, places array<double>, peaks array<double>, top double, stationarity double, rms_ratio double, rms double"


def _search(batches: Iterator[pa.RecordBatch], plan: Search, kept: list[str]) -> Iterator[pa.RecordBatch]:
    names = [*kept, *(part.split()[0] for part in FOUND.split(", "))]
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            own = batch.slice(a, 512)
            x = np.asarray(own.column("x").flatten()).reshape(own.num_rows, -1)
            row, lag, place, peak, *rest = search(x, own.column("frame").to_numpy() * plan.step, plan)
            offsets = pa.array(np.searchsorted(row, np.arange(own.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(float))) for v in (lag, place, peak)]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *lists, *map(pa.array, rest)], names=names)


def candidates_of(frames: DataFrame, plan: Search) -> DataFrame:
    """Rows (utt, frame, x, and others that stay) with the candidates of each frame in place of x: FOUND. Frames are rows, so streams do as well.

    x holds `plan.back` samples before the frame (0 before the signal's start) and `plan.ahead` from it on.
    """
    kept = [c for c in frames.columns if c != "x"]
    schema = ", ".join([*(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept), FOUND])
    return frames.mapInArrow(partial(_search, plan=plan, kept=kept), schema)


def candidates(signal: DataFrame, rate: float, config: PitchConfig = PitchConfig()) -> DataFrame:
    """(utt, frame, FOUND) of signals (utt, i, x) in 16-bit units; frames that lack samples after them are left out."""
    plan = Search(rate, config)
    own = signal.select("utt", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    silence = own.where("i = 0").select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.back - 1).cast("long"))).alias("i"), F.lit(0.0).alias("x"))
    shifted = own.withColumn("i", F.col("i") + plan.back).unionByName(silence)
    return candidates_of(framed(shifted, plan.back + plan.ahead, plan.step), plan)


def _block(batch: pa.RecordBatch) -> Candidates:
    """A batch's frames as matrices as wide as its longest list."""
    lists = [batch.column(c) for c in ("lags", "places", "peaks")]
    sizes = np.diff(np.asarray(lists[0].offsets))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = []
    for column in lists:
        out = np.full((batch.num_rows, int(sizes.max(initial=0))), np.nan)
        out[row, at] = np.asarray(column.flatten())
        wide.append(out)
    return Candidates(batch.column("frame").to_numpy(), *wide, *(batch.column(c).to_numpy() for c in ("top", "stationarity", "rms_ratio", "rms")))


PATH = "utt long, frame long, f0 double, peak double, rms double"


def rows_of(utt: int, decided: list[tuple], rate: float) -> pa.RecordBatch:
    frame, place, peak, rms = zip(*decided, strict=True) if decided else ((), (), (), ())
    f0 = [rate / p if p else 0.0 for p in place]
    return pa.RecordBatch.from_arrays([pa.array([utt] * len(decided), pa.int64()), pa.array(frame, pa.int64()), *(pa.array(v, pa.float64()) for v in (f0, peak, rms))], names=["utt", "frame", "f0", "peak", "rms"])


def _walk(batches: Iterator[pa.RecordBatch], costs: Costs, rate: float, limit: int | None) -> Iterator[pa.RecordBatch]:
    lattice = utt = None
    for batch in batches:
        keys = batch.column("utt").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if lattice is not None and keys[a] != utt:
                yield rows_of(utt, lattice.finish(), rate)
                lattice = None
            if lattice is None:
                lattice, utt = Lattice(costs, limit), int(keys[a])
            for start in range(a, b, 512):
                own = batch.slice(start, min(512, b - start))
                decided = list(lattice.step(_block(own)))
                if decided:
                    yield rows_of(utt, decided, rate)
    if lattice is not None:
        yield rows_of(utt, lattice.finish(), rate)


def paths(found: DataFrame, rate: float, config: PitchConfig = PitchConfig(), limit: int | None = None) -> DataFrame:
    """(utt, frame, f0, peak, rms) of candidates (utt, frame, FOUND): the cheapest path of each utterance; f0 is 0 where it is unvoiced.

    An utterance's frames pass through a task in order; only frames that are not decided stay there, with a byte
    for each candidate. With a `limit` at most that many stay, as a stream has it.
    """
    own = found.repartition("utt").sortWithinPartitions("utt", "frame")
    return own.mapInArrow(partial(_walk, costs=Search(rate, config).costs, rate=rate, limit=limit), PATH)


def track(signal: DataFrame, rate: float, config: PitchConfig = PitchConfig()) -> DataFrame:
    """(utt, frame, f0, peak, rms) of signals (utt, i, x); see `candidates` and `paths`."""
    return paths(candidates(signal, rate, config), rate, config)
