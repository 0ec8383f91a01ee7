"""Queries of framing and spectra, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spectral as P
from . import views as V
from .signal_queries import rounded

LENGTH, STEP = 16, 8
SLOPE = [1 + (j * 4000.0 / 9) ** 2 / 2.5e5 for j in range(9)]
#: Filters of the small fixed frame, as (filter, bin, weight).
CONFIG = P.SpectralConfig(win_len_ms=2.0, win_inc_ms=1.0, fb_low=0.0, fb_hi=4000.0, num_cep=5, linear=True, tgt_num_filt=7)


def _frames(spark, sf_dir):
    return P.framed(V.signals(spark, sf_dir), LENGTH, STEP)


def _long(df, name, index):
    return df.select("utt", "frame", F.posexplode(name).alias(index, "v"))


def _ready(spark, sf_dir):
    return _frames(spark, sf_dir).select("utt", "frame", P.windowed(P.without_mean(F.col("x")), LENGTH).alias("x"))


def _spectrum(spark, sf_dir):
    return P.in_batches(_ready(spark, sf_dir), P.power_of).withColumnRenamed("x", "p")


def _emphasised(spark, sf_dir):
    return P.in_batches(_ready(spark, sf_dir), lambda x: P.power_of(x) * SLOPE).withColumnRenamed("x", "p")


def _filterbank(spark, sf_dir):
    bank = CONFIG.filterbank()
    return P.in_batches(_ready(spark, sf_dir), lambda x: P.log_filterbank(P.power_of(x) * SLOPE, bank)).withColumnRenamed("x", "fb")


def _cepstrum(spark, sf_dir):
    bank, cosines = CONFIG.filterbank(), CONFIG.cosines()
    return P.in_batches(_ready(spark, sf_dir), lambda x: P.log_filterbank(P.power_of(x) * SLOPE, bank) @ cosines.T).withColumnRenamed("x", "c")


def _centers(spark, sf_dir):
    rates = spark.createDataFrame([(r, k, c) for r in (8000, 16000) for k, c in enumerate(P.mel_centers(r / 2))], "rate int, k int, hz double")
    return rounded(rates, "hz")


def _warped(spark, sf_dir):
    grid = spark.range(0, 4001, 50).select(F.col("id").cast("double").alias("hz"))
    return rounded(grid.select("hz", P.warp(F.col("hz"), 0.9, 4000.0).alias("warped")), "warped")


def _dither(spark, sf_dir):
    return rounded(V.signals(spark, sf_dir).select("utt", "i", P.uniform(F.col("i") + 1).alias("u")), "u", digits=8)


QUERIES = {
    "frame_count": lambda spark, sf_dir: V.signals(spark, sf_dir).groupBy("utt").agg(P.frame_count(F.count(F.lit(1)), LENGTH, STEP).alias("frames")),
    "frame_split": lambda spark, sf_dir: rounded(_long(_frames(spark, sf_dir), "x", "k"), "v"),
    "frame_dc_remove": lambda spark, sf_dir: rounded(_long(_frames(spark, sf_dir).withColumn("x", P.without_mean(F.col("x"))), "x", "k"), "v", digits=8),
    "frame_hamming": lambda spark, sf_dir: rounded(_long(_frames(spark, sf_dir).withColumn("x", P.windowed(F.col("x"), LENGTH)), "x", "k"), "v"),
    "frame_energy": lambda spark, sf_dir: rounded(_frames(spark, sf_dir).select("utt", "frame", P.energy(P.windowed(P.without_mean(F.col("x")), LENGTH)).alias("energy")), "energy"),
    "frame_dft_power": lambda spark, sf_dir: rounded(_long(_spectrum(spark, sf_dir), "p", "bin"), "v", digits=3),
    "spec_preemphasis": lambda spark, sf_dir: rounded(_long(_emphasised(spark, sf_dir), "p", "bin"), "v", digits=3),
    "filterbank_log": lambda spark, sf_dir: rounded(_long(_filterbank(spark, sf_dir), "fb", "filter"), "v", digits=4),
    "cepstrum": lambda spark, sf_dir: rounded(_long(_cepstrum(spark, sf_dir), "c", "k"), "v", digits=4),
    "mel_centers": _centers,
    "mel_warp": _warped,
    "dither_uniform": _dither,
    "mfcc_numpy": lambda spark, sf_dir: rounded(_long(P.cepstra(V.signals(spark, sf_dir), CONFIG), "base", "k"), "v", digits=4),
}

_FRAMES = f"""WITH {V.SIGNALS}, n AS (SELECT utt, CASE WHEN count(*) < {LENGTH} THEN 0 ELSE (count(*) - {LENGTH}) // {STEP} + 1 END AS frames FROM signals GROUP BY utt),
g AS (SELECT utt, unnest(generate_series(0, frames - 1)) AS frame FROM n WHERE frames > 0), k AS (SELECT unnest(generate_series(0, {LENGTH - 1})) AS k),
f AS (SELECT g.utt, g.frame, k.k, s.x FROM g CROSS JOIN k JOIN signals s ON s.utt = g.utt AND s.i = g.frame * {STEP} + k.k),
z AS (SELECT utt, frame, k, x, x - avg(x) OVER (PARTITION BY utt, frame) AS c FROM f),
w AS (SELECT utt, frame, k, c * (0.54 - 0.46 * cos({P.TWO_PI}::DOUBLE * k / {LENGTH - 1})) AS v FROM z)"""
_POWER = f"""{_FRAMES}, b AS (SELECT unnest(generate_series(0, {LENGTH // 2})) AS bin),
p AS (SELECT utt, frame, bin, pow(sum(v * cos(2 * pi() * bin * k / {LENGTH})), 2) + pow(sum(v * sin(2 * pi() * bin * k / {LENGTH})), 2) AS p FROM w CROSS JOIN b GROUP BY ALL),
e AS (SELECT utt, frame, bin, p * (1 + pow(bin * 4000.0::DOUBLE / 9, 2) / 2.5e5) AS p FROM p)"""
# Triangles by their definition: eight steps of 500 Hz up to 4,000, bins of 500 Hz; the last centre is beyond the band.
_BANK = f"""{_POWER}, tri AS (SELECT a.filter, b.bin, CASE WHEN b.bin < a.filter + 1 THEN b.bin - a.filter ELSE a.filter + 2 - b.bin END AS w
  FROM (SELECT unnest(generate_series(0, {CONFIG.filterbank().shape[0] - 1})) AS filter) a JOIN b ON b.bin > a.filter AND b.bin < a.filter + 2 AND b.bin < 8),
fb AS (SELECT utt, frame, filter, 10 * log10(sum(e.p * tri.w) + 1e-20) - 40 AS v FROM e JOIN tri USING (bin) GROUP BY ALL)"""
_N = CONFIG.filterbank().shape[0]
CEPSTRA = f"""{_BANK}, o AS (SELECT unnest(generate_series(1, 5)) AS k),
long AS MATERIALIZED (SELECT utt, frame, k - 1 AS d, sum(v * cos(k * (filter + 0.5) * pi() / {_N}) / {_N}) AS v FROM fb CROSS JOIN o GROUP BY ALL)"""
_CEPSTRUM = f"{CEPSTRA} SELECT utt, frame, CAST(d AS INTEGER) AS k, round(v, 4) + 0.0 AS v FROM long"

ORACLES = {
    "frame_count": f"WITH {V.SIGNALS} SELECT utt, CASE WHEN count(*) < {LENGTH} THEN 0 ELSE (count(*) - {LENGTH}) // {STEP} + 1 END AS frames FROM signals GROUP BY utt",
    "frame_split": f"{_FRAMES} SELECT utt, frame, CAST(k AS INTEGER) AS k, round(x, 5) + 0.0 AS v FROM f",
    "frame_dc_remove": f"{_FRAMES} SELECT utt, frame, CAST(k AS INTEGER) AS k, round(c, 8) + 0.0 AS v FROM z",
    "frame_hamming": f"{_FRAMES} SELECT utt, frame, CAST(k AS INTEGER) AS k, round(x * (0.54 - 0.46 * cos({P.TWO_PI}::DOUBLE * k / {LENGTH - 1})), 5) + 0.0 AS v FROM f",
    "frame_energy": f"{_FRAMES} SELECT utt, frame, round(10 * log10(sum(v * v) + 1e-20) - 40, 5) + 0.0 AS energy FROM w GROUP BY utt, frame",
    "frame_dft_power": f"{_POWER} SELECT utt, frame, CAST(bin AS INTEGER) AS bin, round(p, 3) + 0.0 AS v FROM p",
    "spec_preemphasis": f"{_POWER} SELECT utt, frame, CAST(bin AS INTEGER) AS bin, round(p, 3) + 0.0 AS v FROM e",
    "filterbank_log": f"{_BANK} SELECT utt, frame, CAST(filter AS INTEGER) AS filter, round(v, 4) + 0.0 AS v FROM fb",
    "cepstrum": _CEPSTRUM,
    "mfcc_numpy": _CEPSTRUM,
    "mel_centers": f"""WITH RECURSIVE c AS (SELECT r.rate, 0 AS k, 0.0::DOUBLE AS hz FROM (VALUES (8000), (16000)) AS r(rate)
      UNION ALL SELECT rate, k + 1, CASE WHEN k < 10 THEN hz + 100 ELSE hz * 1.1::DOUBLE END FROM c WHERE hz < rate / 2) SELECT rate, k, round(hz, 5) + 0.0 AS hz FROM c""",
    "mel_warp": f"""WITH g AS (SELECT unnest(generate_series(0, 4000, 50))::DOUBLE AS hz), r AS (SELECT hz, hz * {math.pi}::DOUBLE / 4000 AS r FROM g)
      SELECT hz, round((r + 2 * atan(0.1::DOUBLE * sin(r) / (1 - 0.1::DOUBLE * cos(r)))) * 4000 / {math.pi}::DOUBLE, 5) + 0.0 AS warped FROM r""",
    "dither_uniform": f"""WITH RECURSIVE {V.SIGNALS}, g AS (SELECT 0 AS k, 55555::BIGINT AS a, 99999::BIGINT AS b
      UNION ALL SELECT k + 1, a * 40014 % 2147483563, b * 40692 % 2147483399 FROM g WHERE k <= (SELECT max(i) FROM signals))
      SELECT utt, i, round((CASE WHEN a + b - 2147483563 < 1 THEN a + b - 1 ELSE a + b - 2147483563 END) / 2147483563.0::DOUBLE, 8) + 0.0 AS u FROM signals JOIN g ON g.k = i + 1""",
}
