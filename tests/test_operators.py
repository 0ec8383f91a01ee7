"""Closed forms, sequential restatements and round trips of the speech operators."""

import struct
import tracemalloc
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.functions import g711
from voxlake.operators import blocks, embed, features, gmm, intervals, pipes, pitch, sad, segment, signal, spectral
from voxlake.plans import spectral_queries
from voxlake.sources import audio, files
from voxlake.streaming.energy import energy_sad_stream


def signal_of(spark, x, utt=1):
    return spark.createDataFrame([(utt, k, float(v)) for k, v in enumerate(x)], "utt long, i long, x double").repartition(3)


def frames_of(spark, x, utt=1):
    return spark.createDataFrame([(utt, k, [float(v) for v in row]) for k, row in enumerate(x)], "utt long, frame long, base array<double>").repartition(3)


def column(df, name, order="frame"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_companding(spark):
    rows = spark.range(256).select("id", g711.ulaw(F.col("id")).alias("u"), g711.alaw(F.col("id")).alias("a")).orderBy("id").collect()
    assert rows[255]["u"] == 4 and rows[127]["u"] == -4 and max(r["u"] for r in rows) == 32124
    assert [r["a"] for r in rows[:4]] == [-5504, -5248, -6016, -5760] and rows[32]["a"] == -22016


def test_halo_windows_equal_whole_windows(spark):
    x = np.random.default_rng(0).normal(size=95)
    own = blocks.with_halo(signal_of(spark, x), "i", 3, 2, size=10)
    shifted = own.withColumn("v", blocks.clamped(F.col("x"), -3, "i", "utt")).withColumn("w", blocks.clamped(F.col("x"), 2, "i", "utt"))
    out = blocks.own_rows(shifted).orderBy("i").collect()
    at = np.arange(95)
    assert [r["v"] for r in out] == x[np.maximum(at - 3, 0)].tolist() and [r["w"] for r in out] == x[np.minimum(at + 2, 94)].tolist()


def test_signal_filters_equal_numpy(spark):
    x, h = np.random.default_rng(1).normal(size=60), [0.5, -0.2, 0.1]
    assert column(signal.fir(signal_of(spark, x), h), "x", "i") == pytest.approx(np.convolve(x, h))
    up = np.zeros(7)
    up[::3] = h
    assert column(signal.fir(signal_of(spark, x), h, 3), "x", "i") == pytest.approx(np.convolve(x, up))
    assert column(signal.preemphasis(signal_of(spark, [2.0] * 4), 0.5), "x", "i") == [2.0, 1.0, 1.0, 1.0]
    assert column(signal.sliced(signal_of(spark, x), -10, None, 3), "x", "i") == x[-10::3].tolist()
    assert column(signal.sliced(signal_of(spark, x), 50, 3, -4), "x", "i") == x[50:3:-4].tolist()
    with pytest.raises(ValueError, match="even"):
        signal.complementary_ifir(signal_of(spark, x), h, 3, [1.0, 2.0])
    with pytest.raises(ValueError):
        signal.quantize(signal_of(spark, x))


def test_resampling_keeps_a_tone(spark):
    t = np.arange(1600)
    out = np.array(column(signal.resample(signal_of(spark, np.sin(2 * np.pi * 440 * t / 16000)), 16000), "x", "i"))
    want = np.sin(2 * np.pi * 440 * np.arange(len(out)) / 8000)
    assert np.abs(out - want)[40:-40].max() < 0.01
    with pytest.raises(ValueError):
        signal.resample(signal_of(spark, [1.0]), 8000, signal.TO_16K)


def test_filterbank_facts(spark):
    assert [len(spectral.mel_centers(r / 2)) - 2 for r in (8000, 16000)] == [24, 31]
    for rate in (8000.0, 16000.0):
        assert spectral.SpectralConfig(sample_rate=rate).filterbank().shape[0] == 20
    assert spectral.SpectralConfig(linear=True, tgt_num_filt=100).filterbank().shape[0] == 72
    assert spectral.draws(4) == pytest.approx([0.9300048435, 0.9249852219, 0.5057980530, 0.9687642666])
    assert spectral.draws(3, 1001) == pytest.approx(spectral.draws(1003)[1000:])
    u = spark.range(1, 5).select(spectral.uniform(F.col("id")).alias("u")).collect()
    assert [r["u"] for r in u] == pytest.approx(spectral.draws(4).tolist())
    assert spark.range(1).select(spectral.frame_count(F.lit(800), 160, 80).alias("n")).head()["n"] == 9
    with pytest.raises(ValueError):
        spectral.SpectralConfig(num_cep=20).validate()


def test_cepstra_of_a_tone(spark):
    t = np.arange(800)
    config = spectral.SpectralConfig(fb_only=True)
    rows = spectral.cepstra(signal_of(spark, 1000 * np.sin(2 * np.pi * 1000 * t / 8000)), config).orderBy("frame").collect()
    assert len(rows) == 9
    peak = int(np.argmax(rows[4]["base"]))
    own = config.filterbank()[peak]
    assert abs(np.argmax(own) * 8000 / 256 - 1000) < 80
    dithered = spectral.cepstra(signal_of(spark, np.zeros(800)), spectral.SpectralConfig(dither=1.0)).count()
    assert dithered == 9


def test_temporal_features(spark):
    ramp = frames_of(spark, [[k, 3.0] for k in range(20)])
    d = features.regression(ramp, 2)
    assert column(d, "delta")[10] == pytest.approx([1.0, 0.0])
    assert column(features.difference(ramp, 2), "delta")[10] == pytest.approx([4.0, 0.0])
    assert len(column(features.shifted_deltas(d, 3, 7), "sdc")[0]) == 14 and len(column(features.shifted_deltas(d, 3, 4), "sdc")[0]) == 8
    assert column(features.select_features(features.regression(d, 2, "delta", "accel"), "all"), "features")[10] == pytest.approx([10, 3, 1, 0, 0, 0], abs=1e-9)
    for bad in ("x", "s", "e"):
        with pytest.raises(ValueError):
            features.select_features(d, bad)
    with pytest.raises(ValueError):
        features.shifted_deltas(ramp, 3, 7)


def rasta_loop(x):
    taps, y, out = features.TAPS, 0.0, []
    for i in range(len(x) + 2):
        y = features.POLE * y + sum(c * x[min(max(i - k, 0), len(x) - 1)] for k, c in enumerate(taps))
        out.append(y)
    return out[2:]


@pytest.mark.parametrize("n", [1, 2, 3, 255, 257, 1100])
def test_rasta_equals_its_recursion(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 2)).cumsum(0)
    got = np.array(column(features.rasta(frames_of(spark, x)), "base"))
    assert got == pytest.approx(np.array([rasta_loop(x[:, d]) for d in (0, 1)]).T, abs=1e-9)


def test_rasta_of_a_constant_is_zero_and_norm_of_one_too(spark):
    own = frames_of(spark, [[5.0]] * 40)
    assert np.abs(column(features.rasta(own), "base")).max() < 1e-9
    assert np.abs(column(features.normalise(own), "base")).max() == 0


def detector(e, least, threshold):
    state = sad.EnergyState()
    return [state.step(v, least, threshold) for v in e]


def test_energy_detector_and_its_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    e = np.where(np.arange(1500) % 200 < 80, 60, 20) + rng.normal(size=1500)
    e[900:] += 130
    rows = [(u, k, float(v)) for u in (1, 2) for k, v in enumerate(e + u)]
    df = spark.createDataFrame(rows, "utt long, frame long, energy double")
    batch = sad.energy_sad(df, 5.0, 15.0).orderBy("utt", "frame").collect()
    assert [r["sad"] for r in batch] == detector(e + 1, 5.0, 15.0) + detector(e + 2, 5.0, 15.0)
    for part in range(3):
        df.where(f"frame >= {part * 500} and frame < {part * 500 + 500}").coalesce(1).write.parquet(f"{tmp_path}/in{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = energy_sad_stream(stream, 5.0, 15.0).writeStream.format("memory").queryName("labels").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("labels").orderBy("utt", "frame").collect() == batch


def majority(raw, length):
    """The circular buffer, one frame after another."""
    half, out = length // 2, list(raw)
    for m in range(half, len(raw)):
        ahead = [raw[min(k, len(raw) - 1)] for k in range(m, m + half + 1)]
        out[m] = int(sum(out[m - half : m]) + sum(ahead) > half)
    return out


def test_median_is_the_recursive_majority():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4, 60):
        raw = rng.integers(0, 2, n)
        assert sad.smoothed(raw, 6).tolist() == majority(raw.tolist(), 7)


def test_majority_as_a_stream_equals_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 7, 200):
        for length in (1, 3, 7, 11):
            raw, own = rng.integers(0, 2, n).tolist(), sad.Majority(length)
            out = [v for v in map(own.push, raw) if v is not None] + own.finish()
            assert out == (sad.smoothed(np.array(raw, int), length).tolist() if n else [])
    rows = [(u, k, float(v)) for u, n in ((1, 900), (2, 3), (3, 250)) for k, v in enumerate(np.abs(rng.normal(20, 15, n)))]
    df = spark.createDataFrame(rows, "utt long, frame long, energy double")
    raw = {}
    for r in sad.energy_sad(df, 5.0, 15.0).orderBy("utt", "frame").collect():
        raw.setdefault(r["utt"], []).append(r["sad"])
    want = [(u, k, v) for u, x in raw.items() for k, v in enumerate(sad.smoothed(np.array(x), 9).tolist())]
    assert sorted(map(tuple, sad.energy_sad(df, 5.0, 15.0, median=8).collect())) == want
    ends = df.groupBy("utt").agg(F.max("frame").alias("end"))
    marked = df.join(ends, "utt").select("utt", "frame", "energy", (F.col("frame") == F.col("end")).alias("last"))
    for part in range(3):
        marked.where(f"floor(frame / 301) = {part}").coalesce(1).write.parquet(f"{tmp_path}/in{part}")
    stream = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = energy_sad_stream(stream, 5.0, 15.0, median=8).writeStream.format("memory").queryName("majorities").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("majorities").collect())) == want


def test_shortfall_keeps_scores_within_its_bound(spark):
    rng = np.random.default_rng(5)
    background = gmm.Mixture.of(np.full(32, 1 / 32), rng.normal(size=(32, 20)) * 2, rng.uniform(0.5, 2, (32, 20)))
    target = background.with_means(background.mean + 0.1)
    x = rng.normal(size=(400, 20)) * 2
    chosen = np.argsort(-background.log_density(x), axis=1)[:, :5]
    exact = target.log_density_of(x, chosen, background)
    for shortfall in (0.5, 10.0, 1e9):
        q, skipped = target.log_density_within(x, chosen, shortfall, background)
        keep = exact >= exact.max(1, keepdims=True) - shortfall / 2 - 1e-9
        assert (np.isfinite(q) == keep).all() and np.allclose(q[keep], exact[keep])
        lost = gmm.log_sum(exact) - gmm.log_sum(q)
        assert (lost >= -1e-9).all() and (lost <= np.log1p(4 * np.exp(-shortfall / 2)) + 1e-9).all() and (skipped > 1000) == (shortfall < 1e9)
        order = rng.permutation(5)
        again, _ = target.log_density_within(x, chosen[:, order], shortfall, background)
        assert np.allclose(gmm.log_sum(again), gmm.log_sum(q))
    frames = frames_of(spark, x)
    rows = {r["model"]: r for r in gmm.score_models(frames, background, {"t": target}, shortfall=10.0).collect()}
    whole = {r["model"]: r["score"] for r in gmm.score_models(frames, background, {"t": target}).collect()}
    assert 0 <= whole["t"] - rows["t"]["score"] <= np.log1p(4 * np.exp(-5)) and rows["background"]["score"] == pytest.approx(whole["background"])
    assert 0.02 < rows["t"]["skipped"] < 1 and rows["background"]["skipped"] == 0


def test_splits_in_blocks_equal_whole_windows(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=95)
    whole = segment.splits(signal_of(spark, x), 5).orderBy("i").collect()
    monkeypatch.setattr(segment, "SIZE", 10)
    parts = segment.splits(signal_of(spark, x), 5).orderBy("i").collect()
    assert [r["i"] for r in whole] == [r["i"] for r in parts] == list(range(5, 91))
    np.testing.assert_allclose([[r["t2"], r["bic"], r["n1"]] for r in whole], [[r["t2"], r["bic"], r["n1"]] for r in parts])


def marks(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b), 1) for a, b in rows], "utt long, start double, stop double, label int")


def test_interval_algebra(spark):
    pairs = lambda df: [(r["start"], r["stop"]) for r in df.orderBy("start").collect()]
    assert pairs(intervals.merged(marks(spark, [(0, 1), (1.3, 2), (4, 4.1)]), 0.5, 0.2)) == [(0, 2)]
    assert pairs(intervals.subtract(marks(spark, [(0, 10)]), marks(spark, [(3, 4), (6, 12)]))) == [(0, 3), (4, 6)]
    assert pairs(intervals.intersect(marks(spark, [(0, 10)]), marks(spark, [(3, 4), (6, 12)]))) == [(3, 4), (6, 10)]
    assert pairs(intervals.subtract(marks(spark, [(0, 10)]), marks(spark, []))) == [(0, 10)]
    once = intervals.merged(marks(spark, [(0, 1), (2, 3), (9, 9.5)]), 1.5, 0.2)
    assert pairs(intervals.merged(once, 1.5, 0.2)) == pairs(once)


def test_strict_labels_raise(spark):
    lengths = spark.createDataFrame([(1, 5)], "utt long, n long")
    labels = spark.createDataFrame([(1, k, 1) for k in range(3)], "utt long, frame long, sad int")
    assert column(sad.labels_for(lengths, labels, sloppy=True), "sad") == [1, 1, 1, 0, 0]
    with pytest.raises(Exception, match="differ"):
        sad.labels_for(lengths, labels).collect()


@pytest.fixture(scope="module")
def mixture():
    rng = np.random.default_rng(2)
    return gmm.Mixture.of(np.array([0.5, 0.3, 0.2]), rng.normal(size=(3, 4)) * 3, rng.uniform(0.5, 2, size=(3, 4)))


def test_mixtures(spark, mixture):
    x = np.random.default_rng(5).normal(size=(50, 4)) * 2
    rows = gmm.densities(frames_of(spark, x), mixture).collect()
    assert all(sum(r["posterior"]) == pytest.approx(1) for r in rows)
    whole = gmm.sufficient_statistics(frames_of(spark, x), mixture).orderBy("mix").collect()
    q = mixture.log_density(x)
    p = np.exp(q - gmm.log_sum(q)[:, None])
    assert [r["ec"] for r in whole] == pytest.approx(p.sum(0)) and [r["f"] for r in whole] == pytest.approx(p.T @ x)
    with pytest.raises(Exception, match="features"):
        gmm.score(frames_of(spark, x[:, :2]), mixture).collect()
    again = files.parse_mixture(files.mixture_bytes(mixture))
    assert again.mean == pytest.approx(mixture.mean, rel=1e-6) and again.inv_var == pytest.approx(mixture.inv_var, rel=1e-6)


def test_ivector_recovers_factors(spark, mixture):
    rng = np.random.default_rng(8)
    total, w = rng.normal(size=(12, 3)), np.array([0.5, -1.0, 2.0])
    ec = np.array([10.0, 20.0, 30.0])
    f = ec[:, None] * (mixture.mean + (total @ w).reshape(3, 4))
    stats = spark.createDataFrame([(1, k, float(ec[k]), f[k].tolist()) for k in range(3)], "utt long, mix int, ec double, f array<double>")
    assert embed.ivector(stats, total, mixture).head()["vec"] == pytest.approx(w.tolist())
    vec = spark.createDataFrame([([3.0, 4.0],)], "vec array<double>")
    assert embed.project_out(vec, [[1.0, 0.0]], 1).head()["vec"] == [0.0, 4.0] and embed.project_out(vec, [], 0).head()["vec"] == [3.0, 4.0]
    with pytest.raises(ValueError):
        embed.project_out(vec, [], 1)


def test_changes_and_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 1, size=(200, 3)) for m in (0, 4, 0)])
    own = frames_of(spark, x)
    rule = segment.ChangeRule(weight=2.0)  # short windows near a stretch's end make chance changes at a weight of 1
    found = segment.segment(own, rule).orderBy("start").collect()
    assert [r["start"] for r in found][1:] == pytest.approx([200, 400], abs=8)
    clusters = segment.cluster(segment.segment(own, rule), own).orderBy("start").collect()
    assert [r["cluster"] for r in clusters] == [0, 1, 0]
    one = spark.createDataFrame([(1, 0, 600)], "utt long, start long, stop long")
    assert segment.cluster(one, own).head()["cluster"] == 0
    flat = spark.createDataFrame([(1, 0, 5, 0)], "utt long, start long, stop long, cluster long")
    assert files.cluster_marks(flat, 10.0).head()["line"] == "c0 0.00 0.05"
    assert files.cluster_xml(flat, 10.0).head()["element"] == '<segment start="0" end="50"><model>c0</model></segment>'


def test_predictor_solves_the_normal_equations(spark):
    rng = np.random.default_rng(5)
    size, apart, order = 60, 40, 6
    xs = [rng.normal(size=size + apart), np.sin(np.arange(size + apart) * 0.3) * 900, np.zeros(size + apart)]
    frames = spark.createDataFrame([(0, k, x.tolist()) for k, x in enumerate(xs)], "utt long, frame long, x array<double>")

    def solved(x):
        r = np.array([x[: size - d] @ x[d:] for d in range(order + 1)])
        r[1:] /= 1 + 10**-1.5
        full = r[np.abs(np.subtract.outer(range(order + 1), range(order + 1)))]
        a = np.append(1.0, np.linalg.solve(full[1:, 1:], -r[1:]))
        return a, a @ full @ a, full

    own = frames.select("frame", pitch.predictor(pitch.autocorrelation(F.col("x"), size, order), order).alias("p")).orderBy("frame").collect()
    out = pitch.stationarity(frames, size, apart, order).orderBy("frame").collect()
    for x, row, change in zip(xs[:2], own, out, strict=False):
        a, gain, _ = solved(x[:size])
        _, after, full = solved(x[apart:])
        np.testing.assert_allclose(row.p.a, a, rtol=1e-6)
        assert np.isclose(row.p.gain, gain)
        assert np.isclose(change.stationarity, 0.2 / (a @ full @ a / after - 0.8))
    assert out[1].stationarity > out[0].stationarity
    assert own[2].p.a == [1.0] + [0.0] * order and own[2].p.gain == 0 and out[2].stationarity == 0 == out[2].rms_ratio


def test_pitch_of_a_harmonic_tone(spark):
    t = np.arange(4000) / 8000
    x = sum(np.sin(2 * np.pi * 125 * k * t) / k for k in (1, 2, 3)) * 3000
    out = pitch.track(signal_of(spark, x), 8000.0).collect()
    voiced = [r["f0"] for r in out if r["f0"] > 0]
    assert len(voiced) > 0.8 * len(out) and np.median(voiced) == pytest.approx(125, rel=0.02)
    with pytest.raises(ValueError):
        pitch.track(signal_of(spark, x), 100.0)


def sphere(x, coding, extra=""):
    head = f"NIST_1A\n   1024\nsample_rate -i 8000\nsample_coding -s{len(coding)} {coding}\nsample_n_bytes -i {2 if coding == 'pcm' else 1}\nchannel_count -i 2\n{extra}end_head\n"
    return head.encode().ljust(1024, b"\0") + x


def test_audio_files(spark, tmp_path):
    x = np.array([[1, -2], [3, -4], [500, -600]], np.int16)
    (tmp_path / "a.sph").write_bytes(sphere(x.tobytes(), "pcm"))
    (tmp_path / "b.sph").write_bytes(sphere(x.astype(">i2").tobytes(), "pcm", "sample_byte_format -s2 10\n"))
    rows = audio.read(spark, f"{tmp_path}/*.sph", audio.parse_sphere).collect()
    assert sorted((r["channel"], r["samples"]) for r in rows) == [(0, [1, 3, 500])] * 2 + [(1, [-2, -4, -600])] * 2
    (tmp_path / "u").write_bytes(sphere(bytes([255, 127, 0, 1]), "ulaw"))
    got = audio.exploded(audio.read(spark, f"{tmp_path}/u", audio.parse_sphere)).collect()
    assert sorted(r["x"] for r in got) == sorted([4.0, -4.0, -32124.0, -31100.0])
    form = struct.pack("<HHIIHH", 1, 2, 16000, 64000, 4, 16)
    body = x.astype("<i2").tobytes()
    wave = b"RIFF\0\0\0\0WAVELIST\x03\0\0\0abc\0data" + struct.pack("<I", len(body)) + body + b"fmt \x10\0\0\0" + form
    (tmp_path / "c.wav").write_bytes(wave)
    own = audio.read(spark, f"{tmp_path}/c.wav", audio.parse_wave, sum_channels=True).head()
    assert own["samples"] == [-1, -1, -100] and own["sample_rate"] == 16000
    content = audio.encoded(signal_of(spark, [1.7, -1.7, 40000]), 8000).head()["content"]
    assert audio.parse_wave(bytes(content))[2].ravel().tolist() == [1, -1, 32767]
    raw = audio.encoded(signal_of(spark, [1.5, -1.5]), 8000, wave=False).head()["content"]
    assert audio.raw_parser(8000)(bytes(raw))[2].ravel().tolist() == [2, -2]
    for bad in (lambda: audio.raw_parser(0), lambda: audio.raw_parser(8000)(b""), lambda: audio.parse_sphere(b"x"), lambda: audio.parse_wave(b"RIFF")):
        with pytest.raises(ValueError):
            bad()


def test_text_files(spark, tmp_path):
    (tmp_path / "labels").write_text("0 1\n1\n")
    (tmp_path / "marks").write_text("speech 0.5 1.25\n\nspeech  2 3\n")
    np.arange(6, dtype="<f4").tofile(tmp_path / "raw")
    assert column(files.read_labels(spark, f"{tmp_path}/labels"), "sad") == [0, 1, 1]
    assert [(r["tag"], r["start_s"], r["dur_s"]) for r in files.read_marks(spark, f"{tmp_path}/marks").orderBy("start_s").collect()] == [("speech", 0.5, 1.25), ("speech", 2.0, 3.0)]
    assert column(files.read_features(spark, f"{tmp_path}/raw", 3), "base") == [[0, 1, 2], [3, 4, 5]]
    assert files.read_matrix(spark, f"{tmp_path}/raw", 2).shape == (3, 2)
    with pytest.raises(Exception, match="whole number"):
        files.read_features(spark, f"{tmp_path}/raw", 4).collect()


def brute_clusters(parts, threshold):
    """Of all pairs, again and again, the two most alike."""
    parts, of = dict(enumerate(parts)), list(range(len(parts)))
    while len(parts) > 1:
        value, a, b = min((segment.delta_bic(parts[a], parts[b], 1.0), a, b) for a in parts for b in parts if a < b)
        if value >= threshold:
            break
        parts[a] = tuple(x + y for x, y in zip(parts[a], parts.pop(b), strict=True))
        of = [a if k == b else k for k in of]
    return of


@pytest.mark.parametrize("d", [1, 3])
def test_joining_equals_brute_force(d):
    rng = np.random.default_rng(d)
    parts = [(float(len(x)), x.sum(0), x.T @ x) for x in (rng.normal(rng.integers(4), 1, (12, d)) for _ in range(24))]
    n, s, q = (np.array(x) for x in zip(*parts, strict=True))
    for threshold in (-2.0, 0.0, 5.0):
        assert segment.agglomerated(n, s, q, 1.0, threshold) == brute_clusters(parts, threshold)


def test_utterances_with_many_segments_are_clustered(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, [float(rng.normal(k // 10 % 2 * 1000, 1))]) for k in range(12_000)]
    frames = spark.createDataFrame(rows, "utt long, frame long, base array<double>")
    pieces = frames.groupBy("utt", (F.floor(F.col("frame") / 10) * 10).alias("start")).count().select("utt", "start", (F.col("start") + 10).alias("stop"))
    found = segment.cluster(pieces, frames).collect()
    high, low = ({r["cluster"] for r in found if r["start"] // 10 % 2 == k} for k in (1, 0))
    assert len(found) == 1_200 and not high & low and max(high | low) < 200


def test_detector_keeps_its_floor_for_a_while_and_then_takes_a_new_level():
    state, floors = sad.EnergyState(), []
    for e in [2000.0] * 600 + [200.0] * 80:
        state.step(e, 5.0, 15.0)
        floors.append(state.floor)
    fell = next(k for k in range(600, 680) if floors[k] < 1800)
    assert 615 <= fell <= 625 and floors[610] > 1990 and floors[-1] < 250
    quiet = sad.EnergyState()
    assert [quiet.step(1.0, 5.0, 15.0) for _ in range(3)] == [0, 0, 0] and quiet.seen == 3 and not quiet.history


@pytest.mark.parametrize("n", [1, 7, 64, 65, 95])
def test_filters_and_frames_over_many_blocks(spark, n):
    rng = np.random.default_rng(n)
    x, h = rng.normal(size=n), rng.normal(size=9)
    own = signal_of(spark, x)
    cut = lambda before, after, run, **more: column(blocks.by_block(own, before, after, run, size=16, **more), "x", more.get("name", "i"))
    assert cut(8, 0, partial(signal._convolved, taps=h)) == pytest.approx(np.convolve(x, h))
    for up, down, offset in ((1, 2, 4), (3, 2, 0), (5, 7, 4), (1, 1, 4), (1, 1, 11)):
        want = [sum(x[i] * h[k] for i in range(n) if 0 <= (k := down * j - up * i + offset) < 9) for j in range(up * (n - 1) // down + 1)]
        got = cut(max(0, -(-(8 - offset) // up)) + 1, offset // up + 2, partial(signal._stepped, taps=h, up=up, down=down, offset=offset))
        assert got == pytest.approx(want)
        assert column(signal.fir_up_down(own, h, up, down, offset), "x", "i") == pytest.approx(want)
    want = [x[a : a + 10].tolist() for a in range(0, n - 9, 3)]
    assert cut(0, 10, partial(spectral._cut, length=10, step=3), name="frame", matrix=True) == want


def test_blocks_of_many_utterances_and_of_none(spark):
    rows = [(f"u{u}", k, float(u * k)) for u in range(40) for k in range(u)]
    own = spark.createDataFrame(rows, "utt string, i long, x double").repartition(5)
    got = {}
    for r in signal.fir(own, [1.0, 1.0]).collect():
        got.setdefault(r["utt"], {})[r["i"]] = r["x"]
    assert {u: [v[i] for i in sorted(v)] for u, v in got.items()} == {f"u{u}": pytest.approx(np.convolve([u * k for k in range(u)], [1, 1])) for u in range(1, 40)}
    assert signal.fir(own.where("false"), [1.0]).count() == 0 and spectral.framed(own.where("utt = 'u3'"), 4, 2).count() == 0
    holes = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, 3.0), (None, 0, 1.0)], "utt long, i long, x double")
    assert column(signal.fir(holes, [1.0, 1.0]), "x", "i") == [0.0, 2.0, 5.0, 3.0]


@pytest.mark.parametrize("samples", [10, 17])
def test_a_batch_bounds_what_blocks_leave_behind(samples):
    """Very many utterances, too short for a frame or just long enough for one, are not held beyond a batch."""
    n = 100

    def fed(count):
        for k in range(0, count, n):
            utt, i = np.repeat(np.arange(k, k + n), samples), np.tile(np.arange(samples), n)
            yield pa.record_batch({"utt": utt, "block": np.zeros(len(i), np.int64), "i": i, "x": i * 1.0})

    def peak(count):
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in blocks._run(fed(count), partial(spectral._cut, length=16, step=8), 65_536, "frame"))
            assert rows == (count if samples > 16 else 0)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(n)
    assert peak(50_000) < 1.5 * peak(10_000)


def test_cepstra_take_one_python_worker_a_task(spark):
    """Frames become features where they are cut; the table of decisions needs no Python."""
    plan = spectral.cepstra(signal_of(spark, np.zeros(800)), spectral.SpectralConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    scores = spark.range(3).select(F.col("id").alias("utt"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), F.col("id").cast("double").alias("score"))
    plan = gmm.decide(scores, {"x": ("a", "b")})._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and gmm.decide(scores, {}).count() == 0
    assert [tuple(r) for r in gmm.decide(scores, {"x": ("a", "b")}).orderBy("utt").collect()] == [(k, "x", 0.0) for k in range(3)]


def test_configurations():
    text = '{"feat_type": "mfcc", "alpha": "1", "dither": "0.5", "fb_low": 300, "fb_hi": 3140, "keep_c0": "true", "linear": 0, "num_cep": "6", "win_inc_ms": 10, "win_len_ms": 20, "other": 1}'
    assert pipes.spectral_config(text) == spectral.SpectralConfig(dither=0.5, keep_c0=True, num_cep=6)
    assert pipes.spectral_config(pipes.SPEAKER).num_cep == 19 and pipes.spectral_config(pipes.LANGUAGE, 16000.0).length == 320
    for bad in ({"alpha": 1}, pipes.SPEAKER | {"feat_type": "plp"}, pipes.SPEAKER | {"num_cep": 1.5}, pipes.SPEAKER | {"linear": "maybe"}, "[]"):
        with pytest.raises(ValueError):
            pipes.spectral_config(bad)
    with pytest.raises(ValueError, match="sample"):
        pipes.spectral_config(pipes.SPEAKER | {"win_inc_ms": 0}).validate()


def test_recipes_on_a_tone_between_silences(spark):
    t = np.arange(8000)
    x = np.where((t >= 2400) & (t < 5600), 5000 * np.sin(t * 0.6), 0) + np.random.default_rng(1).normal(size=8000)
    own, settings = signal_of(spark, x), pipes.LANGUAGE | {"dither": 0}
    frames = features.select_features(features.regression(features.rasta(spectral.cepstra(own, pipes.spectral_config(settings))), 2), "fd")
    rows = np.array(column(frames, "features"))
    at = np.arange(len(rows))
    loud = (at >= 32) & (at < 66)
    models = {name: gmm.Mixture.of(np.ones(1), rows[k].mean(0)[None], rows[k].var(0)[None]) for name, k in (("quiet", ~loud), ("tone", loud))}
    speech = {"feat_config": settings, "label_keep": "tone", "label_window": 5, "min_gap_dur": 0.1, "min_seg_dur": 0.1}
    (found,) = pipes.speech_intervals(own, speech, models).collect()
    assert abs(found["start"] - 30) <= 6 and abs(found["stop"] - 70) <= 6
    config = {"pipe_config": {"feat_config": settings, "do_rasta": True, "do_delta": True, "delta_spread": 1, "do_accel": "1", "accel_spread": 1, "do_feat_norm": True, "outfeat": "all"}}
    kept = pipes.feature_pipe(own, config, pipes.by_mixtures(speech, models))
    assert column(kept, "frame") == list(range(found["stop"] - found["start"]))
    values = np.array(column(kept, "features"))
    assert values.shape[1] == 18 and values.mean(0) == pytest.approx(np.zeros(18), abs=1e-9) and values.std(0) == pytest.approx(np.ones(18))
    whole = pipes.feature_pipe(own, {"pipe_config": {"feat_config": settings}})
    assert whole.count() == 99 and "base" in whole.columns
    assert pipes.feature_pipe(own.where("false"), config, pipes.by_energy({"abs_min_energy": 0, "thresh": 1})).count() == 0
    with pytest.raises(ValueError, match="delta_spread"):
        pipes.feature_pipe(own, {"pipe_config": {"feat_config": settings, "do_delta": True}})


def test_directions_are_taken_out(spark, mixture):
    frames = frames_of(spark, np.random.default_rng(3).normal(size=(60, 4)) * 2)
    plain = np.array(pipes.supervectors(frames, {"rf": 4}, mixture).head()["vec"])
    row = np.random.default_rng(4).normal(size=(1, 13))
    row /= np.sqrt((row**2).sum())
    none = pipes.supervectors(frames, {"rf": "4", "do_nap": True, "corank": 0}, mixture, row).head()["vec"]
    assert none == pytest.approx(plain.tolist())
    ec = np.array([r["ec"] for r in gmm.sufficient_statistics(frames, mixture).orderBy("mix").collect()])
    share = np.concatenate([[1], np.repeat(np.sqrt(ec / ec.sum()) / np.exp(0.5 * mixture.log_weight), 4)])
    x = plain / share
    out = pipes.supervectors(frames, {"rf": 4, "do_nap": "true", "corank": 1}, mixture, row).head()["vec"]
    assert out == pytest.approx(((x - (x @ row[0]) * row[0]) * share).tolist())
    for bad in ({}, {"rf": 4, "do_nap": True}, {"rf": 4, "do_nap": True, "corank": 2}):
        with pytest.raises(ValueError):
            pipes.supervectors(frames, bad, mixture, row)


def test_trials_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "VALUES", 7)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    enrolled = spark.createDataFrame([(f"m{k}", v.tolist()) for k, v in enumerate(a)], "model string, model_vec array<double>")
    tests = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(b)], "test long, vec array<double>")
    got = {(r["model"], r["test"]): r["score"] for r in embed.trials(enrolled, tests).collect()}
    assert got == pytest.approx({(f"m{i}", j): float(a[i] @ b[j]) for i in range(5) for j in range(4)})
    assert embed.trials(enrolled.where("false"), tests).count() == 0


def test_intervals_are_cut_inside_only(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1, size=(200, 2)) for m in (0, 6, 0)])
    rows = [(1, 0, 390, "speech"), (1, 390, 410, "speech"), (1, 410, 600, "music"), (2, 0, 100, "speech")]
    own = spark.createDataFrame(rows, "utt long, start long, stop long, label string")
    found = segment.segment_intervals(frames_of(spark, x), own, speech_only=True).orderBy("utt", "start").collect()
    assert [(r["utt"], r["label"]) for r in found] == [(1, "speech")] * 3 + [(1, "music"), (2, "speech")]
    assert found[1]["start"] == found[0]["stop"] == pytest.approx(200, abs=8) and found[1]["stop"] == 390


def test_numbers_of_clusters_are_bounded():
    rng = np.random.default_rng(3)
    parts = [(20.0, x.sum(0), x.T @ x) for x in (rng.normal(m, 1, (20, 1)) for m in (0, 0, 30, 30, 90, 90))]
    n, s, q = (np.array(x) for x in zip(*parts, strict=True))
    of = lambda *bounds: len(set(segment.agglomerated(n, s, q, 1.0, 0.0, *bounds)))
    assert of() == 3 and of(5) == 5 and of(1, 2) == 2 and of(7) == 6 and of(1, 9) == 3
    assert segment.agglomerated(n[:0], s[:0], q[:0], 1.0, 0.0, 1, 1) == []


def test_floats_and_lengths(spark, tmp_path):
    content = audio.encoded_floats(signal_of(spark, [0.5, -1.25, 3.0])).head()["content"]
    (tmp_path / "x.f32").write_bytes(bytes(content) + b"\0")
    assert column(audio.read_floats(spark, str(tmp_path)), "x", "i") == [0.5, -1.25, 3.0]
    assert audio.lengths(spark, str(tmp_path)).head()["length"] == 13
    vec = files.vector_bytes(spark.createDataFrame([(1, [1.0, 2.5])], "utt long, vec array<double>")).head()
    assert np.frombuffer(vec["content"]).tolist() == [1.0, 2.5]
    (tmp_path / "m").mkdir()
    model = gmm.Mixture.of(np.ones(1), np.zeros((1, 2)), np.ones((1, 2)))
    (tmp_path / "m" / "a.mod").write_bytes(files.mixture_bytes(model))
    assert files.read_models(spark, {"model_dir": f"{tmp_path}/m", "gmm_models": {"a": "a.mod"}})["a"].mean.shape == (1, 2)


def test_chosen_gaussians_score_as_in_the_whole(mixture):
    x = np.random.default_rng(0).normal(size=(2050, 4))
    chosen = np.argsort(-mixture.log_density(x), axis=1)[:, :2]
    assert mixture.log_density_of(x, chosen) == pytest.approx(np.take_along_axis(mixture.log_density(x), chosen, 1))


def test_means_add_samples_in_their_order(spark):
    """Wherever the rows lie, the last bit is that of a plain sum, which truncation to whole samples can show."""
    rng = np.random.default_rng(5)
    x = {u: [round(float(v), 2) for v in rng.uniform(0, 560, n)] for u, n in ((1, 4_000), (2, 67), (3, 1))}
    rows = [(u, k, v) for u, own in x.items() for k, v in enumerate(own)]
    order = rng.permutation(len(rows))
    rows_of_x = spark.createDataFrame([rows[k] for k in order], "utt long, i long, x double").repartition(7)
    got = {(r["utt"], r["i"]): r["x"] for r in signal.remove_mean(rows_of_x).collect()}
    for u, own in x.items():
        total = 0.0
        for v in own:
            total += v
        assert [got[u, k] for k in range(len(own))] == [v - total / len(own) for v in own]
    parted = {r["utt"]: r["mean"] for r in signal.means(rows_of_x, 16).collect()}
    assert all(parted[u] == pytest.approx(sum(own) / len(own)) for u, own in x.items())
    empty = spark.createDataFrame([(1, 0, None), (2, 0, 1.0), (2, 1, None)], "utt long, i long, x double")
    assert {r["utt"]: r["mean"] for r in signal.means(empty).collect()} == {1: None, 2: 1.0}


def test_spectra_of_frames_are_matrices(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 16))
    rows = spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(x)], "utt long, frame long, x array<double>").repartition(3)
    got = np.array(column(spectral.in_batches(rows, spectral.power_of), "x"))
    assert got == pytest.approx(np.abs(np.fft.rfft(x, axis=1)) ** 2)
    assert spectral.in_batches(rows.limit(0), spectral.power_of).count() == 0
    plan = spectral_queries.QUERIES["cepstrum"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") <= 2
