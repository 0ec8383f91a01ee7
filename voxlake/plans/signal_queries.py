"""Queries of the signal operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import g711
from ..operators import signal as S
from . import views as V

TAPS = (0.25, 0.5, 0.25, -0.1)
SECOND = (0.5, 0.3, 0.2)
SYMMETRIC = (0.1, 0.2, 0.4, 0.2, 0.1)
RATE = (0.2, 0.5, 0.9, 1.0, 0.9, 0.5, 0.2)


def rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def _on(view, operator):
    return lambda spark, sf_dir: rounded(operator(view(spark, sf_dir)), "x")


def _updates(spark, sf_dir):
    own = V.signals(spark, sf_dir)
    return S.assigned(own, own.where("i % 7 = 3").select("utt", "i", F.lit(-1.0).alias("x")))


def _decoded(coded: DataFrame, law) -> DataFrame:
    """Count, sum, weighted sum and range of the decoded samples of each utterance."""
    x = coded.select("utt", "i", law(F.col("u")).cast("long").alias("x"))
    return x.groupBy("utt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * (F.col("i") % 97)).alias("weighted"), F.min("x").alias("low"), F.max("x").alias("high")
    )


QUERIES = {
    "sig_normalize": _on(V.signals, S.normalize),
    "sig_remove_mean": _on(V.signals, S.remove_mean),
    "sig_preemphasis": _on(V.signals, lambda d: S.preemphasis(d, 0.97)),
    "sig_fir": _on(V.signals, lambda d: S.fir(d, TAPS)),
    "sig_fir_upsampled": _on(V.signals, lambda d: S.fir(d, TAPS, 3)),
    "sig_ifir_complement": _on(V.signals, lambda d: S.complementary_ifir(d, SECOND, 3, SYMMETRIC)),
    "sig_zero_phase_fir": _on(V.signals, lambda d: S.fir_zero_phase(d, SYMMETRIC)),
    "sig_updn_resample": _on(V.signals, lambda d: S.fir_up_down(d, RATE, 3, 2)),
    "resample_8k": _on(V.signals, lambda d: S.resample(d, 16000)),
    "resample_8k_rational": _on(V.signals, lambda d: S.resample(d, 44100)),
    "resample_16k": _on(V.signals, lambda d: S.resample(d, 48000, S.TO_16K)),
    "sig_quantize_clip": lambda spark, sf_dir: S.quantize(V.signals(spark, sf_dir).withColumn("x", (F.col("x") - 60) * 300.3), clip=True),
    "sig_quantize_scale": lambda spark, sf_dir: S.quantize(S.remove_mean(V.signals(spark, sf_dir)), scale=True, truncate=True),
    "sig_slice_stride": _on(V.signals, lambda d: S.sliced(d, 5, -3, 2)),
    "sig_reverse": _on(V.signals, lambda d: S.sliced(d, None, None, -1)),
    "sig_assign": lambda spark, sf_dir: rounded(_updates(spark, sf_dir), "x"),
    "g711_ulaw": lambda spark, sf_dir: _decoded(V.sample_bytes(spark, sf_dir), g711.ulaw),
    "g711_alaw": lambda spark, sf_dir: _decoded(V.sample_bytes(spark, sf_dir), g711.alaw),
    "sig_describe": lambda spark, sf_dir: V.signals(spark, sf_dir).groupBy("utt").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / 8000.0).alias("seconds")),
}

_W = f"WITH {V.SIGNALS}"


def _taps(name, taps):
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({k}, CAST({h} AS DOUBLE))' for k, h in enumerate(taps))}) AS t(k, h))"


def _conv(source, name, stride):
    """Grid of all output samples, and the sum over taps."""
    return f"""(SELECT g.utt, g.i, coalesce(sum(s.x * t.h), 0) AS x
      FROM (SELECT utt, unnest(generate_series(0, max(i) + (SELECT max(k) FROM {name}) * {stride})) AS i FROM {source} GROUP BY utt) g
      CROSS JOIN {name} t LEFT JOIN {source} s ON s.utt = g.utt AND s.i = g.i - t.k * {stride} GROUP BY g.utt, g.i)"""


def _resampled(up, down):
    taps = S.low_pass(up, down)
    at = f"{down} * g.i - {up} * s.i + {len(taps) // 2}"
    return f"""{_W}, {_taps('t1', taps)}, g AS (SELECT utt, unnest(generate_series(0, {up} * max(i) // {down})) AS i FROM signals GROUP BY utt)
      SELECT g.utt, g.i, round(sum(s.x * t.h), 5) + 0.0 AS x FROM g JOIN signals s ON s.utt = g.utt JOIN t1 t ON t.k = {at} GROUP BY g.utt, g.i"""


_BYTES = """raw AS (SELECT doc_id AS utt, hex(encode(text)) AS h FROM documents WHERE text <> ''),
pos AS (SELECT utt, h, unnest(generate_series(0, length(h) // 2 - 1)) AS i FROM raw),
bytes AS (SELECT utt, i, CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) AS u FROM pos)"""

_SUMS = "SELECT utt, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * (i % 97)) AS BIGINT) AS weighted, min(x) AS low, max(x) AS high FROM x GROUP BY utt"

ORACLES = {
    "sig_normalize": f"{_W} SELECT utt, i, round(x * 32767.0 / CASE WHEN max(abs(x)) OVER w > 0 THEN max(abs(x)) OVER w ELSE 1 END, 5) + 0.0 AS x FROM signals WINDOW w AS (PARTITION BY utt)",
    "sig_remove_mean": f"{_W} SELECT utt, i, round(x - avg(x) OVER (PARTITION BY utt), 5) + 0.0 AS x FROM signals",
    "sig_preemphasis": f"{_W} SELECT utt, i, round(x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY utt ORDER BY i), 0), 5) + 0.0 AS x FROM signals",
    "sig_fir": f"{_W}, {_taps('t1', TAPS)} SELECT utt, i, round(x, 5) + 0.0 AS x FROM {_conv('signals', 't1', 1)}",
    "sig_fir_upsampled": f"{_W}, {_taps('t1', TAPS)} SELECT utt, i, round(x, 5) + 0.0 AS x FROM {_conv('signals', 't1', 3)}",
    "sig_ifir_complement": f"""{_W}, {_taps('t1', SECOND)}, {_taps('t2', SYMMETRIC)}, a AS {_conv('signals', 't1', 3)}, b AS {_conv('a', 't2', 1)}
      SELECT b.utt, b.i, round(coalesce(s.x, 0) - b.x, 5) + 0.0 AS x FROM b LEFT JOIN signals s ON s.utt = b.utt AND s.i = b.i - 5""",
    "sig_zero_phase_fir": f"""{_W}, {_taps('t1', SYMMETRIC)}, a AS {_conv('signals', 't1', 1)}
      SELECT s.utt, s.i, round(a.x, 5) + 0.0 AS x FROM signals s JOIN a ON a.utt = s.utt AND a.i = s.i + 2""",
    "sig_updn_resample": f"""{_W}, {_taps('t1', RATE)}, g AS (SELECT utt, unnest(generate_series(0, 3 * max(i) // 2)) AS i FROM signals GROUP BY utt)
      SELECT g.utt, g.i, round(coalesce(sum(s.x * t.h), 0), 5) + 0.0 AS x FROM g
      LEFT JOIN signals s ON s.utt = g.utt AND 2 * g.i - 3 * s.i BETWEEN 0 AND 6 LEFT JOIN t1 t ON t.k = 2 * g.i - 3 * s.i GROUP BY g.utt, g.i""",
    "resample_8k": _resampled(*S.TO_8K[16000]),
    "resample_8k_rational": _resampled(*S.TO_8K[44100]),
    "resample_16k": _resampled(*S.TO_16K[48000]),
    "sig_quantize_clip": f"""{_W}, q AS (SELECT utt, i, (x - 60) * 300.3::DOUBLE AS x FROM signals)
      SELECT utt, i, CAST(greatest(-32768, least(32767, sign(x) * floor(abs(x) + 0.5))) AS INTEGER) AS x FROM q""",
    "sig_quantize_scale": f"""{_W}, m AS (SELECT utt, i, x - avg(x) OVER (PARTITION BY utt) AS x FROM signals),
      q AS (SELECT utt, i, x * 32767.0 / max(abs(x)) OVER (PARTITION BY utt) AS x FROM m) SELECT utt, i, CAST(trunc(x) AS INTEGER) AS x FROM q""",
    "sig_slice_stride": f"""{_W}, n AS (SELECT *, max(i) OVER (PARTITION BY utt) + 1 AS n FROM signals)
      SELECT utt, (i - 5) // 2 AS i, round(x, 5) + 0.0 AS x FROM n WHERE i >= 5 AND i < n - 3 AND (i - 5) % 2 = 0""",
    "sig_reverse": f"{_W} SELECT utt, max(i) OVER (PARTITION BY utt) - i AS i, round(x, 5) + 0.0 AS x FROM signals",
    "sig_assign": f"{_W} SELECT utt, i, CASE WHEN i % 7 = 3 THEN -1.0::DOUBLE ELSE round(x, 5) + 0.0 END AS x FROM signals",
    "g711_ulaw": f"""WITH {_BYTES}, f AS (SELECT utt, i, 255 - u AS u FROM bytes),
      m AS (SELECT utt, i, u, [0, 132, 396, 924, 1980, 4092, 8316, 16764][(u >> 4) % 8 + 1] + ((u & 15) << CAST((u >> 4) % 8 + 3 AS INTEGER)) AS s FROM f),
      x AS (SELECT utt, i, CAST(CASE WHEN u >= 128 THEN -1 ELSE 1 END * CASE WHEN s = 0 THEN 4 ELSE s END AS BIGINT) AS x FROM m) {_SUMS}""",
    "g711_alaw": f"""WITH {_BYTES}, f AS (SELECT utt, i, xor(u, 85) AS a FROM bytes),
      m AS (SELECT utt, i, a, CASE WHEN (a >> 4) % 8 = 0 THEN (a & 15) * 16 + 8 ELSE ((a & 15) * 16 + 264) << CAST((a >> 4) % 8 - 1 AS INTEGER) END AS s FROM f),
      x AS (SELECT utt, i, CAST(CASE WHEN a >= 128 THEN s ELSE -s END AS BIGINT) AS x FROM m) {_SUMS}""",
    "sig_describe": f"{_W} SELECT utt, count(*) AS n, count(*) / 8000.0::DOUBLE AS seconds FROM signals GROUP BY utt",
}
