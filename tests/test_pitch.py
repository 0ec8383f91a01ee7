"""The pitch tracker: two-stage search, the lattice against all paths, streams against batches."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import pitch
from voxlake.operators.lattice import Candidates, Costs, Lattice
from voxlake.streaming.pitch import pitch_stream, restored, saved

WEIGHTS = Costs(lag=0.3 / 130, change=2.0, octave=0.35, switch=0.005, spectrum=0.5, loudness=0.5, voice_bias=0.0)


def random_frames(rng, n, most):
    lists = [np.sort(rng.choice(np.arange(20, 131), rng.integers(0, most + 1), replace=False)).astype(float) for _ in range(n)]
    width = max(map(len, lists), default=0)
    lags, peaks = np.full((n, width), np.nan), np.full((n, width), np.nan)
    for k, v in enumerate(lists):
        lags[k, : len(v)] = v
        peaks[k, : len(v)] = rng.uniform(0.3, 1, len(v))
    top = np.nan_to_num(peaks, nan=0).max(1, initial=0)
    return Candidates(np.arange(n), lags, lags + 0.25, peaks, top, rng.uniform(0.01, 1, n), rng.uniform(0.2, 3, n), rng.uniform(0, 9, n))


def part(own, a, b):
    return Candidates(*(v[a:b] for v in (own.frame, own.lags, own.places, own.peaks, own.top, own.stationarity, own.rms_ratio, own.rms)))


def cost_of(own, path):
    """A path's cost, straight from the rules."""
    total = 0.0
    for t, k in enumerate(path):
        lag = None if k is None else own.lags[t, k]
        total += own.top[t] if k is None else 1 - own.peaks[t, k] * (1 - lag * WEIGHTS.lag)
        if t:
            was = None if path[t - 1] is None else own.lags[t - 1, path[t - 1]]
            if lag and was:
                d = math.log(lag / was)
                total += 2.0 * min(abs(d), 0.35 + abs(d + math.log(2)), 0.35 + abs(d - math.log(2)))
            elif lag:
                total += 0.005 + 0.5 * own.stationarity[t] + 0.5 / own.rms_ratio[t]
            elif was:
                total += 0.005 + 0.5 * own.stationarity[t] + 0.5 * own.rms_ratio[t]
    return total


def walked(own, cuts, limit=None):
    lattice, out = Lattice(WEIGHTS, limit), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out += lattice.step(part(own, a, b))
        assert limit is None or len(lattice.back) < limit + (b - a)
    return out + lattice.finish()


def chosen(own, rows):
    assert [r[0] for r in rows] == own.frame.tolist()
    return [None if not place else int(np.flatnonzero(own.places[t] == place)[0]) for t, (_, place, *_) in enumerate(rows)]


def test_lattice_finds_the_cheapest_of_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        own = random_frames(rng, n, 3)
        options = [[None, *np.flatnonzero(~np.isnan(own.lags[t])).tolist()] for t in range(n)]
        least = min(cost_of(own, p) for p in itertools.product(*options))
        found = chosen(own, walked(own, [0, *sorted(rng.choice(np.arange(1, n + 1), min(2, n), replace=False).tolist()), n] if n > 1 else [0, 1]))
        assert cost_of(own, found) == pytest.approx(least, abs=1e-12)


def test_frames_leave_when_paths_meet_and_parts_equal_the_whole():
    rng = np.random.default_rng(1)
    own = random_frames(rng, 900, 6)
    whole = walked(own, [0, 900])
    assert whole == walked(own, list(range(0, 901, 10))) == walked(own, [0, 1, 2, 77, 900])
    lattice, most = Lattice(WEIGHTS, 100), 0
    out = []
    for a in range(0, 900, 20):
        lattice = restored(Lattice(WEIGHTS, 100), saved(lattice)) if lattice.costs is not None else lattice
        out += lattice.step(part(own, a, a + 20))
        most = max(most, len(lattice.back))
    assert out + lattice.finish() == whole and most < 60


def test_limit_bounds_what_stays():
    """Two periods that cost the same for ever never meet; with a limit the cheaper path comes out."""
    n = 500
    lags = np.tile([40.0, 57.0], (n, 1))
    own = Candidates(np.arange(n), lags, lags, np.stack([np.full(n, 0.9), 0.9 * (1 - 40 * WEIGHTS.lag) / (1 - 57 * WEIGHTS.lag) * np.ones(n)], 1), np.full(n, 0.95), np.ones(n), np.ones(n), np.ones(n))
    lattice, left = Lattice(WEIGHTS, 100), 0
    for a in range(0, n, 20):
        left += len(list(lattice.step(part(own, a, a + 20))))
        assert len(lattice.back) <= 100
    assert left >= 400 and left + len(lattice.finish()) == n
    free = Lattice(WEIGHTS)
    assert not list(free.step(own)) and len(free.finish()) == n


def test_lattice_is_fast():
    rng = np.random.default_rng(2)
    own = random_frames(rng, 4000, 19)
    start = time.perf_counter()
    assert len(walked(own, list(range(0, 4001, 500)))) == 4000
    assert time.perf_counter() - start < 2  # loops over pairs of candidates took some 0.3 ms a frame


def tone(rate, f0, seconds=0.6, noise=0.0, seed=0):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(np.sin(2 * np.pi * f0 * k * t + k) / k for k in range(1, 6)) * 3000
    return x + np.random.default_rng(seed).normal(size=len(t)) * noise


def rows_of(x, plan):
    padded = np.concatenate([np.zeros(plan.back), x])
    count = (len(padded) - plan.back - plan.ahead) // plan.step + 1
    return np.stack([padded[k * plan.step : k * plan.step + plan.back + plan.ahead] for k in range(count)]), np.arange(count) * plan.step


@pytest.mark.parametrize(("rate", "f0"), [(8000, 125.0), (8000, 310.0), (16000, 97.0), (16000, 220.0)])
def test_coarse_search_finds_what_the_full_one_does(rate, f0):
    x = tone(rate, f0, noise=30)
    coarse, full = pitch.Search(rate, pitch.PitchConfig()), pitch.Search(rate, pitch.PitchConfig(coarse=False))
    row, lag, place, peak, top, *rest = pitch.search(*rows_of(x, coarse), coarse)
    row2, lag2, place2, peak2, top2, *rest2 = pitch.search(*rows_of(x, full), full)
    n, off = min(len(top), len(top2)), []
    for k in range(n):
        strong = {int(v): p for v, p in zip(lag2[row2 == k], place2[row2 == k], strict=True) if peak2[(row2 == k) & (lag2 == v)][0] > 0.8 * top2[k] and v < full.stop - 4 * coarse.every}
        own = dict(zip(lag[row == k].tolist(), place[row == k].tolist(), strict=True))
        assert set(strong) <= set(own)
        off += [abs(own[v] - p) for v, p in strong.items()]
    # A peak at the border of its patch has no neighbour there.
    assert np.mean(np.array(off) < 0.01) > 0.9 and max(off) <= 0.6
    np.testing.assert_allclose(top[:n], top2[:n], rtol=0.01)
    np.testing.assert_allclose(rest[0][:n], rest2[0][:n])
    # Products of samples: all lags at the full rate against coarse lags and seven lags around each coarse peak.
    patches = len(set(zip(row.tolist(), lag.tolist(), strict=True))) * pitch.PATCH * coarse.size / n
    assert full.lags * full.size > (5 if rate == 16000 else 2.5) * ((1 + coarse.lags // coarse.every) * (1 + coarse.size // coarse.every) + patches)


def test_correlation_and_stationarity_equal_their_definitions():
    rng = np.random.default_rng(3)
    plan = pitch.Search(8000, pitch.PitchConfig(coarse=False))
    x = rng.normal(size=4000) * 1000
    frames, known = rows_of(x, plan)
    c = pitch.lagged(frames[:, plan.back :], plan.size, plan.start, plan.lags)
    k = 7
    y = x[k * plan.step : k * plan.step + 400] - x[k * plan.step : k * plan.step + plan.size].mean()
    for lag in (plan.start, 60, plan.stop):
        a, b = y[: plan.size], y[lag : lag + plan.size]
        assert c[k, lag - plan.start] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    stationarity, ratio, rms = pitch._compared(frames, plan, known)
    assert stationarity[0] == 0.002 and rms[0] == 0 and ratio[0] == 1 and stationarity[1] == 0.02

    def model(at):
        w = x[at : at + plan.stat]
        z = pitch.window("hann", plan.stat - 1) * (w[1:] - 0.4 * w[:-1])
        r = np.array([z[: len(z) - d] @ z[d:] for d in range(plan.order + 1)]) / (z @ z)
        r[1:] /= 1 + 10**-1.5
        full = r[np.abs(np.subtract.outer(np.arange(plan.order + 1), np.arange(plan.order + 1)))]
        a = np.append(1, np.linalg.solve(full[1:, 1:], -full[1:, 0]))
        return a, a @ full @ a, full, np.sqrt(((pitch.window("hann", plan.stat) * w) ** 2).mean())

    at = k * plan.step - 40
    a, _, _, loud = model(at)
    _, error, full, before = model(at - plan.apart)
    assert stationarity[k] == pytest.approx(0.2 / (a @ full @ a / error - 0.8))
    assert ratio[k] == pytest.approx((0.001 + loud) / before) and rms[k] == pytest.approx(loud)


def test_windows(spark):
    for kind in ("rectangular", "hamming", "hann", "cos4"):
        row = spark.sql("SELECT array(1D, 2D, 4D, 8D, 16D) AS x").select(pitch.windowed(F.col("x"), 4, kind, 0.5).alias("p"), pitch.windowed(F.col("x"), 4, kind).alias("q")).first()
        w = pitch.window(kind, 4)
        np.testing.assert_allclose(row["q"], w * [1, 2, 4, 8])
        np.testing.assert_allclose(row["p"], w * [1.5, 3, 6, 12])
    assert pitch.window("cos4", 8)[3] == pytest.approx(pitch.window("hann", 8)[3] ** 4)
    with pytest.raises(ValueError):
        pitch.window("round", 3)


def signals(spark):
    rng = np.random.default_rng(4)
    own = {1: np.concatenate([rng.normal(size=2000) * 20, tone(8000, 125), rng.normal(size=2000) * 20, tone(8000, 250)]), 2: tone(8000, 180), 3: rng.normal(size=300), 4: np.zeros(3000)}
    rows = [(u, i, float(v)) for u, x in own.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "utt long, i long, x double").repartition(4)


def test_track_and_stream(spark, tmp_path):
    config = pitch.PitchConfig(low=60, high=400)
    found = pitch.candidates(signals(spark), 8000.0, config)
    want = sorted(map(tuple, pitch.paths(found, 8000.0, config).collect()))
    voiced = lambda utt, a, b: [r[2] for r in want if r[0] == utt and a <= r[1] < b]
    assert {r[0] for r in want} == {1, 2, 4} and not any(voiced(4, 0, 99))
    assert np.median(voiced(1, 30, 75)) == pytest.approx(125, rel=0.005) and np.median(voiced(1, 120, 150)) == pytest.approx(250, rel=0.005)
    assert np.mean([f == 0 for f in voiced(1, 5, 20)]) > 0.5 and np.median(voiced(2, 3, 40)) == pytest.approx(180, rel=0.005)
    plan = pitch.Search(8000.0, config)
    padded = signals(spark).withColumn("i", F.col("i") + plan.back).unionByName(spark.range(plan.back).selectExpr("explode(array(1L, 2L, 3L, 4L)) AS utt", "id AS i", "0D AS x"))
    frames = pitch.framed(padded, plan.back + plan.ahead, plan.step)
    last = frames.groupBy("utt").agg(F.max("frame").alias("end"))
    frames = frames.join(last, "utt").select("utt", "frame", "x", (F.col("frame") == F.col("end")).alias("last")).cache()
    for k in range(4):
        frames.where(f"floor(frame / 45) = {k}").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = pitch_stream(source, 8000.0, config).writeStream.format("memory").queryName("pitches").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(map(tuple, spark.table("pitches").collect())) == want


def test_odd_signals(spark):
    none = spark.createDataFrame([], "utt long, i long, x double")
    assert pitch.track(none, 8000.0).count() == 0
    for bad in ({"low": 0.1}, {"n_cands": 2}, {"cand_thresh": 1.0}, {"step": 0.2}, {"window": 1.0}):
        with pytest.raises(ValueError):
            pitch.track(none, 8000.0, pitch.PitchConfig(**bad))
