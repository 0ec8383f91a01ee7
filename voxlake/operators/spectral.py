"""Framing and spectra: signals cut into overlapping frames, and what is computed in each frame.

Up to the log filterbank everything works on one frame at a time, so frames are rows with an array column
and need no order. The bulk path runs matrix products over Arrow batches of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SIZE, Then, by_block

#: Fixed value: twice pi as the window has it.
TWO_PI = 6.283185308
#: Moduli, multipliers and seeds of the two generators behind the dither.
GENERATORS = ((2_147_483_563, 40_014, 55_555), (2_147_483_399, 40_692, 99_999))
FLOOR = 1e-20


def frame_count(n: Column, length: int, step: int) -> Column:
    """Whole frames in n samples."""
    return F.when(n < length, 0).otherwise(F.floor((n - length) / step) + 1).cast("long")


def _cut(i: np.ndarray, x: np.ndarray, start: int, size: int, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole frames that begin in the block."""
    high = int(i[-1])
    frame = np.arange(-(-start // step), min((start + size - 1) // step, (high - length + 1) // step) + 1)
    if not len(frame):
        return frame, np.zeros((0, length))
    own, held = np.zeros(high - start + 1), np.zeros(high - start + 1, bool)
    own[i - start], held[i - start] = x, True
    at = frame * step - start
    whole = np.lib.stride_tricks.sliding_window_view(held, length)[at].all(1)
    return frame[whole], np.lib.stride_tricks.sliding_window_view(own, length)[at[whole]]


def framed(signal: DataFrame, length: int, step: int, then: Then | None = None) -> DataFrame:
    """(utt, frame, x): frames of `length` samples, `step` apart, each as one array.

    Frames are cut from blocks of consecutive samples, so no task holds an utterance. Frames that the signal's
    end cuts off are left out. With `then` x is what it makes of the numbers and samples of many frames.
    """
    size = max(length, min(SIZE, 4_000_000 * step // length))
    return by_block(signal, 0, length, partial(_cut, length=length, step=step), "frame", matrix=True, size=size, then=then)


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def without_mean(x: Column) -> Column:
    """The frame less its mean."""
    bound = F.transform(F.array(F.struct(x.alias("x"), mean_of(x).alias("m"))), lambda p: F.transform(p["x"], lambda v: v - p["m"]))
    return F.get(bound, F.lit(0))


def hamming(length: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(TWO_PI * k / (length - 1)) for k in range(length)]


def windowed(x: Column, length: int) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, hamming(length))), lambda v, w: v * w)


def energy(x: Column) -> Column:
    """10 log10 of the sum of squares, less 40."""
    return F.log10(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) + FLOOR) * 10 - 40


def uniform(k: Column) -> Column:
    """The k-th draw (from 1) of the dither generator by jumping ahead: a power of each multiplier, without the draws between.

    Squarings are folded over the bits of k, so any partition computes its own draws.
    """

    def state(modulus: int, multiplier: int, seed: int) -> Column:
        powers, p = [], multiplier
        for _ in range(40):
            powers.append(p)
            p = p * p % modulus
        bits = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda b: F.struct(b.alias("b"), F.get(F.array(*[F.lit(v).cast("long") for v in powers]), b).alias("p")))
        on = F.filter(bits, lambda s: F.pmod(F.floor(k / F.pow(F.lit(2.0), s["b"])), F.lit(2)) == 1)
        return F.aggregate(on, F.lit(seed).cast("long"), lambda a, s: (a * s["p"]) % modulus)

    (m1, a1, s1), (m2, a2, s2) = GENERATORS
    z = state(m1, a1, s1) - m1 + state(m2, a2, s2)
    return F.when(z < 1, z + m1 - 1).otherwise(z) / float(m1)


def warp(freq: Column, alpha: float, fmax: float) -> Column:
    """Bilinear warp of a frequency; alpha 1 leaves it."""
    r = freq * math.pi / fmax
    return (r + 2 * F.atan((1 - alpha) * F.sin(r) / (1 - (1 - alpha) * F.cos(r)))) * fmax / math.pi


def mel_centers(fmax: float) -> list[float]:
    """Every 100 Hz up to 1,000, then 10 % apart until fmax is passed."""
    out = [100.0 * k for k in range(11)]
    while out[-1] < fmax:
        out.append(out[-1] * 1.1)
    return out


def linear_centers(fmax: float, filters: int = 0) -> list[float]:
    step = fmax / (filters + 1) if filters > 0 else 100.0
    out = [0.0]
    while out[-1] < fmax - 1e-6:
        out.append(out[-1] + step)
    return out


@dataclass(frozen=True)
class SpectralConfig:
    """Settings of cepstral features; frequencies in Hz, durations in ms."""

    sample_rate: float = 8000.0
    win_len_ms: float = 20.0
    win_inc_ms: float = 10.0
    fb_low: float = 300.0
    fb_hi: float = 3140.0
    num_cep: int = 19
    keep_c0: bool = False
    linear: bool = False
    tgt_num_filt: int = 0
    alpha: float = 1.0
    dither: float = 0.0
    fb_only: bool = False

    @property
    def length(self) -> int:
        n = int(self.win_len_ms * self.sample_rate / 1000)
        return n + n % 2

    @property
    def step(self) -> int:
        return int(self.win_inc_ms * self.sample_rate / 1000)

    @property
    def transform(self) -> int:
        return 1 << (self.length - 1).bit_length()

    def validate(self) -> None:
        if self.length <= 0 or self.step <= 0:
            raise ValueError("window and step must hold a sample at least")
        if not 0 <= self.fb_low <= self.fb_hi <= self.sample_rate / 2:
            raise ValueError("the band must lie between 0 and half the sampling rate")
        if not 0 < self.num_cep <= self.filterbank().shape[0] - (0 if self.keep_c0 else 1):
            raise ValueError("more cepstra than filters")

    def centers(self) -> np.ndarray:
        fmax = self.sample_rate / 2
        plain = np.array(linear_centers(fmax, self.tgt_num_filt) if self.linear else mel_centers(fmax))
        r = plain * np.pi / fmax
        return (r + 2 * np.arctan((1 - self.alpha) * np.sin(r) / (1 - (1 - self.alpha) * np.cos(r)))) * fmax / np.pi

    def filterbank(self) -> np.ndarray:
        """Triangles of unit area over the bins, one row for each filter inside the band."""
        fmax, bins, c = self.sample_rate / 2, self.transform // 2 + 1, self.centers()
        count = len(c) - 2
        if (c[count] + c[count + 1]) / 2 > fmax:
            count -= 1
        f = np.arange(bins) * (fmax / (bins - 1))
        low, mid, high = c[:count, None], c[1 : count + 1, None], c[2 : count + 2, None]
        rows = np.where(f < mid, (f - low) / (mid - low), (high - f) / (high - mid)) * ((f > low) & (f < high) & (f < fmax))
        rows = rows / np.maximum(rows.sum(1, keepdims=True), 1e-30)
        near = [int(np.abs(c[1 : count + 1] - g).argmin()) for g in (self.fb_low, self.fb_hi)]
        return rows[near[0] : near[1] + 1]

    def slope(self) -> np.ndarray:
        """Spectral pre-emphasis of each bin; the bins are spaced as if there were one more."""
        bins = self.transform // 2 + 1
        return 1 + (np.arange(bins) * (self.sample_rate / 2 / bins)) ** 2 / 2.5e5

    def cosines(self) -> np.ndarray:
        n = self.filterbank().shape[0]
        order = np.arange(0 if self.keep_c0 else 1, self.num_cep + (0 if self.keep_c0 else 1))
        return np.cos(order[:, None] * (np.arange(n) + 0.5) * np.pi / n) / n


def draws(count: int, start: int = 1) -> np.ndarray:
    """Dither draws start, start + 1, ... of one utterance."""
    return draws_from([start], count)[0]


def draws_from(starts: Sequence[int], count: int) -> np.ndarray:
    """A row of draws for each start; powers of the multipliers jump to it."""
    states = []
    for modulus, multiplier, seed in GENERATORS:
        powers = np.array(list(accumulate(range(count - 1), lambda s, _: s * multiplier % modulus, initial=1)))  # noqa: B023
        first = np.array([seed * pow(multiplier, int(a), modulus) % modulus for a in starts], np.int64)
        states.append(first[:, None] * powers % modulus)
    z = states[0] - GENERATORS[0][0] + states[1]
    return np.where(z < 1, z + GENERATORS[0][0] - 1, z) / GENERATORS[0][0]


def _cepstra(frame: np.ndarray, x: np.ndarray, config: SpectralConfig) -> np.ndarray:
    """The features of frames, and their energy last."""
    bank, cosines, slope, window = config.filterbank(), config.cosines(), config.slope(), np.array(hamming(config.length))
    if config.dither:
        x = x + config.dither * (2 * draws_from((frame * config.length + 1).tolist(), config.length) - 1)
    x = (x - x.mean(1, keepdims=True)) * window
    e = 10 * np.log10((x * x).sum(1) + FLOOR) - 40
    power = np.abs(np.fft.rfft(x, config.transform, axis=1)) ** 2 * slope
    out = 10 * np.log10(power @ bank.T + FLOOR) - 40
    if not config.fb_only:
        out = out @ cosines.T
    return np.concatenate([out, e[:, None]], axis=1)


def cepstra(signal: DataFrame, config: SpectralConfig) -> DataFrame:
    """(utt, frame, base, energy): dither, mean removal, window, energy, power spectrum, filterbank and cosines of each frame.

    Frames become features where they are cut, so they cross no worker's border.
    """
    config.validate()
    rows = framed(signal, config.length, config.step, partial(_cepstra, config=config))
    n = F.size("x") - 1
    return rows.select(F.col("utt").cast("long").alias("utt"), "frame", F.slice("x", F.lit(1), n).alias("base"), F.get("x", n).alias("energy"))


def _times(batches: Iterator[pa.RecordBatch], run: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            out = run(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(out, float).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("utt"), batch.column("frame"), rows], names=["utt", "frame", "x"])


def in_batches(frames: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(utt, frame, x): what `run` makes of the arrays x, which have equal lengths, as a matrix for each Arrow batch."""
    kind = frames.schema["utt"].dataType.simpleString()
    return frames.select("utt", "frame", "x").mapInArrow(partial(_times, run=run), f"utt {kind}, frame long, x array<double>")


def power_of(x: np.ndarray) -> np.ndarray:
    """Power in bins 0 to half the length of short frames, by its definition as sums of cosines and sines."""
    length = x.shape[1]
    angle = 2 * np.pi * np.arange(length)[:, None] * np.arange(length // 2 + 1) / length
    return (x @ np.cos(angle)) ** 2 + (x @ np.sin(angle)) ** 2


def log_filterbank(power: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """10 log10 of each filter's sum over the bins, less 40."""
    return 10 * np.log10(power @ bank.T + FLOOR) - 40
