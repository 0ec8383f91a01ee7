"""Readers by byte ranges and streaming writers: round trips, many tasks for one file, no half files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.sources import audio, files, ranges
from tests.test_operators import signal_of, sphere


def table(spark, own):
    rows = [(u, i, float(v)) for u, x in own.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "utt long, i long, x double").repartition(5)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {1: rng.integers(-30000, 30000, 50_000) + 0.0, 2: np.array([1.7, -1.7, 40_000, 0.5, -0.5]), 3: rng.normal(size=777) * 100}


def test_wave_is_read_by_many_tasks(spark, tmp_path, signals):
    folder = f"{tmp_path}/w"
    ranges.write_signals(table(spark, signals), folder, "wave", 16000)
    for u, x in signals.items():
        assert open(f"{folder}/{u}.wav", "rb").read() == audio.wave_bytes(x, 16000)
    found = ranges.read_ranges(spark, folder, bytes=10_000)
    assert found.rdd.getNumPartitions() > 10
    rows = audio.exploded(found).join(found.select(F.xxhash64("path", "channel").alias("utt"), "path").distinct(), "utt").collect()
    for u, x in signals.items():
        own = sorted((r["i"], r["x"], r["sample_rate"]) for r in rows if r["path"].endswith(f"/{u}.wav"))
        assert [v for _, v, _ in own] == np.clip(np.trunc(x), -32768, 32767).tolist() and [i for i, _, _ in own] == list(range(len(x))) and {r for *_, r in own} == {16000}
    whole = audio.exploded(audio.read(spark, f"{folder}/1.wav", audio.parse_wave))
    one = audio.exploded(ranges.read_ranges(spark, f"{folder}/1.*", bytes=999))
    assert sorted(map(tuple, one.select("i", "x").collect())) == sorted(map(tuple, whole.select("i", "x").collect()))


def test_raw_float_and_features(spark, tmp_path, signals):
    own = table(spark, signals)
    ranges.write_signals(own, f"{tmp_path}/r", "raw")
    ranges.write_signals(own, f"{tmp_path}/f", "float")
    got = {r["path"].split("/")[-1]: r["samples"] for r in ranges.read_ranges(spark, f"{tmp_path}/r", "raw", rate=8000).collect()}
    assert got["2.raw"] == [2, -2, 32767, 1, -1] and len(got["1.raw"]) == 50_000
    got = {r["path"].split("/")[-1]: r["samples"] for r in ranges.read_ranges(spark, f"{tmp_path}/f", "float").collect()}
    np.testing.assert_array_equal(got["3.f32"], signals[3].astype("f4"))
    x = np.random.default_rng(1).normal(size=(300, 4))
    frames = spark.createDataFrame([(9, k, [float(v) for v in r]) for k, r in enumerate(x)], "utt long, frame long, base array<double>").repartition(4)
    ranges.write_features(frames, f"{tmp_path}/m")
    assert open(f"{tmp_path}/m/9.feat", "rb").read() == x.astype("<f4").tobytes()
    found = ranges.read_ranges(spark, f"{tmp_path}/m", "features", width=4, bytes=640)
    assert found.rdd.getNumPartitions() > 1
    found = found.orderBy("frame")
    np.testing.assert_array_equal([r["base"] for r in found.collect()], x.astype("f4"))
    assert [r["base"] for r in files.read_features(spark, f"{tmp_path}/m", 4).orderBy("frame").collect()] == [r["base"] for r in found.collect()]
    with pytest.raises(Exception, match="whole number"):
        ranges.read_ranges(spark, f"{tmp_path}/m", "features", width=7).collect()


def test_sphere_by_ranges(spark, tmp_path):
    x = np.arange(2_000, dtype=np.int16).reshape(-1, 2)
    (tmp_path / "a.sph").write_bytes(sphere(x.tobytes(), "pcm"))
    (tmp_path / "b.sph").write_bytes(sphere(x.astype(">i2").tobytes(), "pcm", "sample_byte_format -s2 10\n"))
    (tmp_path / "c.sph").write_bytes(sphere(bytes(range(256)), "ulaw"))
    for name, parse in (("a", audio.parse_sphere), ("b", audio.parse_sphere), ("c", audio.parse_sphere)):
        path = f"file://{tmp_path}/{name}.sph"
        parts = ranges.read_ranges(spark, path, "sphere", bytes=100)
        want = audio.exploded(audio.read(spark, path, parse)).select("i", "x")
        assert sorted(map(tuple, audio.exploded(parts).select("i", "x").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="not a WAVE"):
        ranges.read_ranges(spark, f"{tmp_path}/a.sph").collect()
    with pytest.raises(Exception, match="does not exist"):
        ranges.read_ranges(spark, f"{tmp_path}/none").collect()


def test_paths_keep_their_store():
    assert ranges.whole("/data/x", "/data/x/a.wav") == "/data/x/a.wav"
    assert ranges.whole("file:///data/x", "/data/x/a.wav") == "file:///data/x/a.wav"
    assert ranges.whole("hdfs://host:8020/x", "/x/a.wav") == "hdfs://host:8020/x/a.wav"
    assert ranges.whole("s3://bucket/x", "bucket/x/a.wav") == "s3://bucket/x/a.wav"


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bad = signal_of(spark, [1.0, 2.0]).withColumn("x", F.when(F.col("i") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        ranges.write_signals(bad, f"{tmp_path}/x")
    left = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert not left
    ranges.write_signals(signal_of(spark, []), f"{tmp_path}/y")
    assert not list(tmp_path.rglob("*.wav"))
