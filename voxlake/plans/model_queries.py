"""Queries of mixtures, embeddings, change points and pitch, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import embed as E
from ..operators import gmm as G
from ..operators import pipes as R
from ..operators import pitch as P
from ..operators import segment as S
from ..operators.features import normalise
from ..operators.spectral import framed
from . import views as V
from .signal_queries import rounded

SHIFT = {"a_m": 0.02, "a_p": -0.01, "b_m": -0.03, "b_p": 0.015}
RELEVANCE = 4.0


def _model(spark, sf_dir):
    return G.gathered(G.class_models(V.frames(spark, sf_dir)))


def _densities(spark, sf_dir):
    return G.densities(V.frames(spark, sf_dir), _model(spark, sf_dir))


def _targets(model):
    return {name: model.with_means(model.mean + d) for name, d in SHIFT.items()}


def _scores(spark, sf_dir, shortfall=None):
    model = _model(spark, sf_dir)
    return G.score_models(V.frames(spark, sf_dir), model, _targets(model), shortfall=shortfall)


def _statistics(spark, sf_dir):
    return G.sufficient_statistics(V.frames(spark, sf_dir), _model(spark, sf_dir))


def _gsv(spark, sf_dir):
    return E.supervector(_statistics(spark, sf_dir), _model(spark, sf_dir), RELEVANCE)


def _basis():
    """Three rows of 64: constant, alternating and a step, each of length 1 (the last one not orthogonal to the first)."""
    rows = np.stack([np.ones(64), np.where(np.arange(64) % 2, -1.0, 1.0), (np.arange(64) < 16).astype(float)])
    return (rows / np.sqrt((rows**2).sum(1, keepdims=True))).tolist()


def _projected(spark, sf_dir):
    own = V.frames(spark, sf_dir).withColumnRenamed("base", "vec")
    return rounded(E.project_out(own, _basis(), 3).select("utt", "frame", F.posexplode("vec").alias("d", "v")), "v")


def _trials(spark, sf_dir):
    own = V.frames(spark, sf_dir).select((F.col("utt") * 100_000 + F.col("frame")).alias("test"), F.col("base").alias("vec"), "utt")
    means = G.class_models(V.frames(spark, sf_dir)).groupBy("mix").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda x: x["mean"]).alias("model_vec"))
    return E.trials(means.select(F.col("mix").alias("model"), "model_vec"), own)


def _ivector(spark, sf_dir):
    model = _model(spark, sf_dir)
    total = np.random.default_rng(7).normal(size=(model.mean.size, 5))
    return E.ivector(_statistics(spark, sf_dir), total, model).select("utt", F.posexplode("vec").alias("d", "v"))


def _series(spark, sf_dir):
    """Consecutive frames of four rounded features of each supplier, as if of one recording."""
    own = V.big(spark, sf_dir)
    return own.select("utt", F.col("i").alias("frame"), F.array(F.col("x"), F.col("x") % 7, (F.col("x") * F.col("i")) % 11).alias("base"))


def _three(spark, sf_dir):
    """The first three numbers of each embedding."""
    return V.frames(spark, sf_dir).select("utt", "frame", F.slice("base", 1, 3).alias("base"))


def _scalars(spark, sf_dir):
    """Consecutive frames of one feature of each supplier; each frame of a hundred is moved by the hundreds' number, so that some are alike."""
    shift = F.floor(F.col("i") / 100) % 3 * F.col("utt") % 5 * 4
    return V.big(spark, sf_dir).select("utt", F.col("i").alias("frame"), F.array(F.col("x") + shift).alias("base"))


def _fixed(spark, sf_dir):
    own = _series(spark, sf_dir).select("utt", F.floor(F.col("frame") / 100).alias("k")).distinct()
    return own.select("utt", (F.col("k") * 100).alias("start"), (F.col("k") * 100 + 100).alias("stop"))


def _labelled(spark, sf_dir):
    """Stretches of 300 frames, every other one speech."""
    own = _series(spark, sf_dir).groupBy("utt", F.floor(F.col("frame") / 300).alias("k")).agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))
    return own.select("utt", "start", "stop", F.when(F.col("k") % 2 == 0, "speech").otherwise("other").alias("label"))


def _gsv_without(spark, sf_dir):
    """Two directions of the supervector: constant, and alternating."""
    model = _model(spark, sf_dir)
    k = model.mean.size + 1
    rows = np.stack([np.ones(k), np.where(np.arange(k) % 2, -1.0, 1.0)]) / np.sqrt(k)
    return R.supervectors(V.frames(spark, sf_dir), {"rf": str(RELEVANCE), "do_nap": "true", "corank": 2}, model, rows)


def _pieces(spark, sf_dir):
    own = V.signals(spark, sf_dir).withColumn("seg", F.floor(F.col("i") / 12))
    return own.groupBy("utt", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def _lagged(spark, sf_dir):
    c = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda lag: P.correlation(F.col("x"), 16, lag))
    return framed(V.signals(spark, sf_dir), 32, 16).select("utt", "frame", c.alias("c"))


def _peaks(spark, sf_dir):
    return _lagged(spark, sf_dir).select("utt", "frame", "c", F.explode(P.peaks(F.col("c"), 0.3)).alias("k"))


def _itakura(spark, sf_dir):
    """Frames against the two-coefficient predictor of the frame itself without its second half."""
    x = framed(V.signals(spark, sf_dir), 32, 16)
    r = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda lag: F.aggregate(F.zip_with(F.slice("x", F.lit(1), 32 - lag), F.slice("x", lag + 1, 32 - lag), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    own = x.select("utt", "frame", r.alias("r"))
    a = F.array(F.lit(1.0), F.lit(-0.8))
    gain = F.get("r", F.lit(0)) - F.get("r", F.lit(1)) * F.get("r", F.lit(1)) / F.get("r", F.lit(0))
    return rounded(own.select("utt", "frame", P.itakura(F.col("r"), a, gain).alias("distance")), "distance")


def _predictors(spark, sf_dir):
    own = framed(V.signals(spark, sf_dir), 32, 16).withColumn("p", P.predictor(P.autocorrelation(F.col("x"), 32, 2), 2))
    own = own.select("utt", "frame", F.get("p.a", 1).alias("a1"), F.get("p.a", 2).alias("a2"), (F.col("p.gain") / F.aggregate("x", F.lit(1e-9), lambda s, v: s + v * v)).alias("gain"))
    return rounded(own, "a1", "a2", "gain")


QUERIES = {
    "gmm_train_stats": lambda spark, sf_dir: rounded(G.class_models(V.frames(spark, sf_dir)), "mean", "var", "log_w"),
    "gmm_component_logdens": lambda spark, sf_dir: rounded(_densities(spark, sf_dir).select("utt", "frame", F.posexplode("q").alias("mix", "q")), "q", digits=4),
    "gmm_posteriors": lambda spark, sf_dir: rounded(_densities(spark, sf_dir).select("utt", "frame", F.posexplode("posterior").alias("mix", "p")), "p"),
    "gmm_score": lambda spark, sf_dir: rounded(G.score(V.frames(spark, sf_dir), _model(spark, sf_dir)), "score", digits=4),
    "gmm_topm": lambda spark, sf_dir: G.top_mixtures(V.frames(spark, sf_dir), _model(spark, sf_dir), 3),
    "gmm_argmax": lambda spark, sf_dir: G.top_mixtures(V.frames(spark, sf_dir), _model(spark, sf_dir), 1).select("utt", "frame", "mix"),
    "gmm_score_models": lambda spark, sf_dir: rounded(_scores(spark, sf_dir), "score", digits=4),
    "gmm_score_shortfall": lambda spark, sf_dir: rounded(_scores(spark, sf_dir, 2.0).select("utt", "model", "score"), "score", digits=4),
    "lid_pair_decision": lambda spark, sf_dir: rounded(G.decide(_scores(spark, sf_dir), {"a": ("a_m", "a_p"), "b": ("b_m", "b_p")}), "score", digits=4),
    "suff_stats": lambda spark, sf_dir: rounded(_statistics(spark, sf_dir).select("utt", "mix", "ec", F.posexplode("f").alias("d", "f")), "ec", "f", digits=4),
    "map_adapt": lambda spark, sf_dir: rounded(G.map_adapt(_statistics(spark, sf_dir), _model(spark, sf_dir), RELEVANCE).select("utt", "mix", F.posexplode("mean").alias("d", "v")), "v", digits=4),
    "gsv_expand": lambda spark, sf_dir: rounded(_gsv(spark, sf_dir).select("utt", F.posexplode("vec").alias("d", "v")), "v", digits=4),
    "nap_project": _projected,
    "ip_score": lambda spark, sf_dir: rounded(_trials(spark, sf_dir), "score", digits=4),
    "znorm": lambda spark, sf_dir: rounded(E.normalised(_trials(spark, sf_dir), _trials(spark, sf_dir).where("floor(test / 100000) <> model"), "model"), "score", digits=4),
    "tnorm": lambda spark, sf_dir: rounded(E.normalised(_trials(spark, sf_dir), _trials(spark, sf_dir), "test"), "score", digits=4),
    "ztnorm": lambda spark, sf_dir: rounded(E.normalised(z := E.normalised(_trials(spark, sf_dir), _trials(spark, sf_dir), "model"), z, "test"), "score", digits=4),
    "ivector": _ivector,
    "t2_1d_argmax": lambda spark, sf_dir: rounded(S.best_split(S.splits(V.signals(spark, sf_dir), 5), "t2"), "value"),
    "bic_1d_delta": lambda spark, sf_dir: rounded(S.splits(V.signals(spark, sf_dir), 5).select("utt", "i", "bic"), "bic"),
    "bic_summary": lambda spark, sf_dir: rounded(S.summary(S.splits(V.signals(spark, sf_dir), 5), F.lit(0.0)), "mean", "deviation", "share"),
    "cluster_pair_bic": lambda spark, sf_dir: rounded(S.pair_distances(_pieces(spark, sf_dir)), "bic"),
    "segment_speech": lambda spark, sf_dir: S.segment_intervals(_series(spark, sf_dir), _labelled(spark, sf_dir), speech_only=True),
    "cluster_bounded": lambda spark, sf_dir: S.cluster(_fixed(spark, sf_dir), _series(spark, sf_dir), fewest=2, most=3),
    "gsv_nap": lambda spark, sf_dir: rounded(_gsv_without(spark, sf_dir).select("utt", F.posexplode("vec").alias("d", "v")), "v", digits=4),
    "t2_3d_argmax": lambda spark, sf_dir: rounded(S.best_split(S.vector_splits(_three(spark, sf_dir), 5), "t2"), "value", digits=4),
    "segment_scalar": lambda spark, sf_dir: S.segment(_scalars(spark, sf_dir)),
    "cluster_scalar": lambda spark, sf_dir: S.cluster(_fixed(spark, sf_dir), _scalars(spark, sf_dir)),
    "cluster_scalar_bounded": lambda spark, sf_dir: S.cluster(_fixed(spark, sf_dir), _scalars(spark, sf_dir), fewest=2, most=3),
    "segment_bic": lambda spark, sf_dir: S.segment(_series(spark, sf_dir)),
    "cluster_bic": lambda spark, sf_dir: S.cluster(_fixed(spark, sf_dir), _series(spark, sf_dir)),
    "ncc_lag": lambda spark, sf_dir: rounded(_lagged(spark, sf_dir).select("utt", "frame", F.posexplode("c").alias("lag", "c")), "c"),
    "peak_pick": lambda spark, sf_dir: _peaks(spark, sf_dir).select("utt", "frame", "k"),
    "parabolic_peak": lambda spark, sf_dir: rounded(_peaks(spark, sf_dir).select("utt", "frame", "k", P.refined(F.col("c"), F.col("k")).alias("r")).select("utt", "frame", "k", "r.place", "r.height"), "place", "height", digits=4),
    "itakura": _itakura,
    "lpc": _predictors,
    "stationarity": lambda spark, sf_dir: rounded(P.stationarity(framed(V.signals(spark, sf_dir), 48, 16), 32, 16, 2), "stationarity", "rms_ratio", digits=4),
    "pitch_window": lambda spark, sf_dir: rounded(_windowed(spark, sf_dir), "energy", digits=4),
    "pitch_rms": lambda spark, sf_dir: rounded(framed(V.signals(spark, sf_dir), 32, 16).select("utt", "frame", P.windowed_rms(F.col("x"), 32).alias("rms")), "rms"),
    "pitch_track": lambda spark, sf_dir: P.track(V.big(spark, sf_dir), 2000.0, P.PitchConfig(low=60, high=400)),
    "pitch_path": lambda spark, sf_dir: rounded(P.paths(_single_candidates(spark, sf_dir), 2000.0, P.PitchConfig(low=60, high=400)), "f0", "peak"),
    "pipeline_full": lambda spark, sf_dir: flagship(spark, sf_dir),
}


def _windowed(spark, sf_dir):
    """Energy of frames under the fourth power of a Hann window, with pre-emphasis."""
    x = P.windowed(F.col("x"), 31, "cos4", 0.4)
    return framed(V.signals(spark, sf_dir), 32, 16).select("utt", "frame", F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("energy"))


def _single_candidates(spark, sf_dir):
    """One candidate for each frame, made from the sample's value and place, so that a frame has two choices."""
    x, i = F.col("x"), F.col("i")
    lag, peak = x % 7 + 20 + F.floor(i / 40) % 9, F.lit(0.5) + (i * 7 + x) % 50 / 100
    top = F.lit(0.2) + F.floor(i / 20) % 2 * 0.5 + x / 250
    columns = [F.array(lag).alias("lags"), F.array(lag + 0.25).alias("places"), F.array(peak).alias("peaks"), top.alias("top"), ((x % 9 + 1) / 40).alias("stationarity"), ((x % 5 + 2) / 4).alias("rms_ratio")]
    return V.big(spark, sf_dir).select("utt", i.alias("frame"), *columns, x.alias("rms"))


def flagship(spark, sf_dir):
    """Frames are normalised, scored under a mixture of all classes, and each is given its best class."""
    normal = normalise(V.frames(spark, sf_dir))
    model = G.gathered(G.class_models(normal))
    best = F.get(F.array_sort(F.transform("q", lambda q, k: F.struct((-q).alias("q"), k.alias("mix")))), F.lit(0))
    scored = G.densities(normal, model).select("utt", "loglik", best["mix"].alias("mix"))
    out = scored.groupBy("utt").agg(F.count(F.lit(1)).alias("n"), F.avg("loglik").alias("score"), F.sum(F.when(F.col("mix") == F.col("utt"), 1).otherwise(0)).alias("own"))
    return rounded(out, "score", digits=4)


_L = f"""WITH {V.LONG}, m AS (SELECT utt AS mix, d, avg(v) AS mean, greatest(var_pop(v), 1e-6) AS var, ln(count(*) / (SELECT count(*) FROM frames)::DOUBLE) AS log_w FROM long GROUP BY utt, d)"""
_Q = f"""{_L}, q AS (SELECT f.utt, f.frame, m.mix, -0.5 * (sum(ln(m.var)) + 64 * ln(2 * pi()) - 2 * any_value(m.log_w) + sum((f.v - m.mean) ** 2 / m.var)) AS q
  FROM long f JOIN m ON m.d = f.d GROUP BY ALL),
l AS (SELECT utt, frame, max(q) + ln(sum(exp(q - top))) AS loglik FROM (SELECT *, max(q) OVER (PARTITION BY utt, frame) AS top FROM q) GROUP BY utt, frame, top),
p AS (SELECT q.*, exp(q - loglik) AS p FROM q JOIN l USING (utt, frame))"""
_SUFF = f"{_Q}, e AS (SELECT utt, mix, sum(p) AS ec FROM p GROUP BY utt, mix), s AS (SELECT p.utt, p.mix, x.d, sum(p.p * x.v) AS f FROM p JOIN long x USING (utt, frame) GROUP BY ALL)"
_MAP = f"{_SUFF}, a AS (SELECT s.utt, s.mix, s.d, e.ec, m.mean AS mu, m.var, ({RELEVANCE} * m.mean + s.f) / (e.ec + {RELEVANCE}) AS v FROM s JOIN e USING (utt, mix) JOIN m ON m.mix = s.mix AND m.d = s.d)"
_SCORES = f"""{_Q}, k AS (SELECT utt, frame, mix, q FROM q QUALIFY row_number() OVER (PARTITION BY utt, frame ORDER BY q DESC, mix) <= 5),
t(model, shift) AS (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SHIFT.items())}),
tq AS (SELECT t.model, k.utt, k.frame, k.mix, -0.5 * (sum(ln(m.var)) + 64 * ln(2 * pi()) - 2 * any_value(m.log_w) + sum((f.v - m.mean - t.shift) ** 2 / m.var)) AS q
  FROM k JOIN long f USING (utt, frame) JOIN m ON m.mix = k.mix AND m.d = f.d CROSS JOIN t GROUP BY ALL),
al AS (SELECT model, utt, frame, q FROM tq UNION ALL SELECT 'background', utt, frame, q FROM k),
fs AS (SELECT model, utt, frame, any_value(top) + ln(sum(exp(q - top))) AS s FROM (SELECT *, max(q) OVER (PARTITION BY model, utt, frame) AS top FROM al) GROUP BY ALL),
sc AS (SELECT utt, model, avg(s) AS score FROM fs GROUP BY ALL)"""
_TRIALS = f"{_L}, tr AS (SELECT m.mix AS model, f.utt * 100000 + f.frame AS test, sum(f.v * m.mean) AS score FROM long f JOIN m USING (d) GROUP BY ALL)"


def _normed(source, cohort, by, name):
    return f"st_{name} AS (SELECT {by}, avg(score) AS mm, greatest(stddev_pop(score), 1e-9) AS ss FROM {cohort} GROUP BY {by}), {name} AS (SELECT model, test, (score - mm) / ss AS score FROM {source} JOIN st_{name} USING ({by}))"


_SPLIT = f"""WITH {V.SIGNALS}, r AS (SELECT utt, i, count(*) OVER b AS n1, sum(x) OVER b AS s1, sum(x * x) OVER b AS q1, count(*) OVER p AS n, sum(x) OVER p AS s, sum(x * x) OVER p AS q FROM signals
  WINDOW b AS (PARTITION BY utt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY utt)),
v AS (SELECT *, greatest(q / n - (s / n) ** 2, 0) + 1e-6 AS c, greatest(q1 / n1 - (s1 / n1) ** 2, 0) + 1e-6 AS c1, greatest((q - q1) / (n - n1) - ((s - s1) / (n - n1)) ** 2, 0) + 1e-6 AS c2
  FROM r WHERE n1 >= 5 AND n - n1 >= 5),
k AS (SELECT utt, i, n1 * (n - n1) / n::DOUBLE * (s1 / n1 - (s - s1) / (n - n1)) ** 2 / c AS t2, (n * ln(c) - n1 * ln(c1) - (n - n1) * ln(c2)) / 2 - ln(n) AS bic FROM v)"""
_NCC = f"""WITH {V.SIGNALS}, n AS (SELECT utt, (count(*) - 32) // 16 + 1 AS frames FROM signals GROUP BY utt HAVING count(*) >= 32),
g AS (SELECT utt, unnest(generate_series(0, frames - 1)) AS frame FROM n), fr AS (SELECT g.utt, g.frame, s.i - g.frame * 16 AS k, s.x FROM g JOIN signals s ON s.utt = g.utt AND s.i BETWEEN g.frame * 16 AND g.frame * 16 + 31)"""
_LAGS = f"""{_NCC}, mu AS (SELECT utt, frame, avg(x) AS mu FROM fr WHERE k < 16 GROUP BY ALL), z AS (SELECT fr.utt, fr.frame, k, x - mu AS z FROM fr JOIN mu USING (utt, frame)),
c AS (SELECT a.utt, a.frame, b.k - a.k AS lag, sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z) + 1e-12) AS c FROM z a JOIN z b ON a.utt = b.utt AND a.frame = b.frame AND a.k < 16 AND b.k - a.k BETWEEN 0 AND 15 GROUP BY ALL)"""
_PEAKS = f"""{_LAGS}, nb AS (SELECT *, lag(c) OVER w AS l, lead(c) OVER w AS r, max(c) OVER (PARTITION BY utt, frame) AS top FROM c WINDOW w AS (PARTITION BY utt, frame ORDER BY lag)),
pk AS (SELECT utt, frame, CAST(lag AS INTEGER) AS k, l, c, r FROM nb WHERE l IS NOT NULL AND r IS NOT NULL AND c >= l AND c >= r AND c > 0.3 * top)"""

_LPC = f"""{_NCC}, r AS (SELECT utt, frame, sum(x * x) AS r0, sqrt(sum((x * (0.5 - 0.5 * cos({2 * math.pi}::DOUBLE * (k + 0.5) / 32))) ** 2) / 32) AS rms FROM fr GROUP BY ALL),
  s AS (SELECT a.utt, a.frame, sum(a.x * b.x) FILTER (b.k = a.k + 1) / (1 + pow(10, -1.5)) AS r1, sum(a.x * b.x) FILTER (b.k = a.k + 2) / (1 + pow(10, -1.5)) AS r2
    FROM fr a JOIN fr b ON a.utt = b.utt AND a.frame = b.frame AND b.k BETWEEN a.k + 1 AND a.k + 2 GROUP BY ALL),
  c AS (SELECT *, CASE WHEN r0 > 0 THEN r1 * (r2 - r0) / (r0 * r0 - r1 * r1) ELSE 0 END AS a1, CASE WHEN r0 > 0 THEN (r1 * r1 - r0 * r2) / (r0 * r0 - r1 * r1) ELSE 0 END AS a2 FROM r JOIN s USING (utt, frame)),
  lpc AS (SELECT *, r0 + a1 * r1 + a2 * r2 AS gain FROM c)"""

_PATH = f"""WITH RECURSIVE {V.BIG}, c AS (SELECT utt, i AS frame, x AS rms, x % 7 + 20 + i // 40 % 9 AS lag, 0.5::DOUBLE + (i * 7 + x) % 50 / 100 AS peak, 0.2::DOUBLE + i // 20 % 2 * 0.5::DOUBLE + x / 250 AS top, (x % 9 + 1) / 40 AS sta, (x % 5 + 2) / 4 AS ratio FROM big),
l AS (SELECT *, 1 - peak * (1 - lag * (0.3::DOUBLE / 33)) AS v, top AS u, 0.005::DOUBLE + 0.5::DOUBLE * sta + 0.5::DOUBLE / ratio AS enter, 0.005::DOUBLE + 0.5::DOUBLE * sta + 0.5::DOUBLE * ratio AS leave,
  ln(lag / lag(lag) OVER (PARTITION BY utt ORDER BY frame)) AS d FROM c),
m AS (SELECT *, 2 * least(abs(d), 0.35::DOUBLE + least(abs(d + ln(2)), abs(d - ln(2)))) AS change FROM l),
fw AS (SELECT utt, frame, v AS cv, u AS cu, true AS bv, true AS bu FROM m WHERE frame = 0
  UNION ALL SELECT m.utt, m.frame, least(cv + change, cu + enter) + v, least(cv + leave, cu) + u, cv + change <= cu + enter, cv + leave <= cu FROM fw JOIN m ON m.utt = fw.utt AND m.frame = fw.frame + 1),
e AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT utt, frame, cv <= cu AS voiced, bv, bu FROM e QUALIFY frame = max(frame) OVER (PARTITION BY utt)
  UNION ALL SELECT e.utt, e.frame, CASE WHEN bw.voiced THEN bw.bv ELSE bw.bu END, e.bv, e.bu FROM bw JOIN e ON e.utt = bw.utt AND e.frame = bw.frame - 1)"""

_THREE = f"""WITH {V.FRAMES}, v AS (SELECT utt, frame AS i, base[1] AS a, base[2] AS b, base[3] AS c FROM frames),
r AS (SELECT utt, i, count(*) OVER w AS n1, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(c) OVER w AS sc FROM v WINDOW w AS (PARTITION BY utt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT utt, count(*) AS n, sum(a) AS ta, sum(b) AS tb, sum(c) AS tc, covar_pop(a, a) + 1e-6 AS aa, covar_pop(b, b) + 1e-6 AS bb, covar_pop(c, c) + 1e-6 AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc FROM v GROUP BY utt),
g AS (SELECT r.utt, i, n, n1, n1 * (n - n1) / n::DOUBLE AS f, sa / n1 - (ta - sa) / (n - n1) AS x, sb / n1 - (tb - sb) / (n - n1) AS y, sc / n1 - (tc - sc) / (n - n1) AS z, aa, bb, cc, ab, ac, bc,
  aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM r JOIN t USING (utt) WHERE n1 >= 5 AND n - n1 >= 5),
k AS (SELECT utt, i, f / det * (x * x * (bb * cc - bc * bc) + y * y * (aa * cc - ac * ac) + z * z * (aa * bb - ab * ab)
  + 2 * (x * y * (ac * bc - ab * cc) + x * z * (ab * bc - ac * bb) + y * z * (ab * ac - aa * bc))) AS t2 FROM g)"""
_SCALARS = f"{V.BIG}, sc AS (SELECT utt, i, x + i // 100 % 3 * utt % 5 * 4 AS x FROM big)"
_SEGMENT = f"""WITH RECURSIVE {_SCALARS}, p AS MATERIALIZED (SELECT utt, i, sum(x) OVER w AS s, sum(x * x) OVER w AS q, max(i) OVER (PARTITION BY utt) AS last FROM sc WINDOW w AS (PARTITION BY utt ORDER BY i)),
step AS (SELECT utt, 0::BIGINT AS start, 125::BIGINT AS stop, NULL::BIGINT AS cut, last FROM p WHERE i = 0
  UNION ALL SELECT utt, CASE WHEN cut IS NULL THEN start ELSE cut + 1 END, CASE WHEN ended THEN last + 1 WHEN cut IS NULL THEN stop + 50 ELSE cut + 126 END, cut, last FROM (
    SELECT *, last - place < 25 OR bic <= 0 AND stop + 51 - start > 500 AND last - start - 500 < 25 AS ended,
      CASE WHEN last - place < 25 THEN NULL WHEN bic > 0 THEN place WHEN stop + 51 - start > 500 AND last - start - 500 >= 25 THEN start + 500 END AS cut FROM (
      SELECT utt, start, stop, last, place, (n * ln(c) - n1 * ln(greatest(q1 / n1 - (s1 / n1) ** 2, 0) + 1e-6) - (n - n1) * ln(greatest((q - q1) / (n - n1) - ((s - s1) / (n - n1)) ** 2, 0) + 1e-6)) / 2 - ln(n) AS bic FROM (
        SELECT *, s1 / n1 - (s - s1) / (n - n1) AS gap, greatest(q / n - (s / n) ** 2, 0) + 1e-6 AS c FROM (
          SELECT w.utt, w.start, w.stop, w.last, p.i AS place, (w.stop - w.start + 1)::DOUBLE AS n, (p.i - w.start + 1)::DOUBLE AS n1, e.s - coalesce(b.s, 0) AS s, e.q - coalesce(b.q, 0) AS q, p.s - coalesce(b.s, 0) AS s1, p.q - coalesce(b.q, 0) AS q1
          FROM step w JOIN p ON p.utt = w.utt AND p.i >= w.start + 25 AND p.i < w.stop JOIN p e ON e.utt = w.utt AND e.i = w.stop LEFT JOIN p b ON b.utt = w.utt AND b.i = w.start - 1 WHERE w.stop <= w.last))
      QUALIFY row_number() OVER (PARTITION BY utt ORDER BY gap * gap / c * (n1 * (n - n1) / n) DESC, place) = 1))),
starts AS (SELECT utt, 0::BIGINT AS start, last FROM p WHERE i = 0 UNION ALL SELECT utt, cut + 1, last FROM step WHERE cut IS NOT NULL)"""


def _clustered(stop):
    """Greedy joining as a recursion over lists of clusters, while `stop` lets it."""
    cost = lambda n, s, q: f"{n} / 2 * ln(greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0) + 1e-6)"
    return f"""WITH RECURSIVE {_SCALARS}, seg AS (SELECT utt, i // 100 AS k, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM sc GROUP BY ALL),
joined AS (SELECT utt, 0 AS it, list({{'k': k, 'n': n, 's': s, 'q': q, 'own': [k]}} ORDER BY k) AS c FROM seg GROUP BY utt
  UNION ALL SELECT utt, it + 1, list_append(list_filter(c, lambda x: x.k <> a.k AND x.k <> b.k), {{'k': a.k, 'n': a.n + b.n, 's': a.s + b.s, 'q': a.q + b.q, 'own': list_concat(a.own, b.own)}}) FROM (
    SELECT utt, it, c, a, b, {cost('(a.n + b.n)', '(a.s + b.s)', '(a.q + b.q)')} - {cost('a.n', 'a.s', 'a.q')} - {cost('b.n', 'b.s', 'b.q')} - ln(a.n + b.n) AS bic
    FROM (SELECT utt, it, c, unnest(c) AS a, c AS rest FROM joined) CROSS JOIN LATERAL (SELECT unnest(rest) AS b) WHERE a.k < b.k
    QUALIFY row_number() OVER (PARTITION BY utt ORDER BY bic, a.k, b.k) = 1) WHERE {stop}),
last AS (SELECT utt, unnest(c) AS x FROM joined QUALIFY it = max(it) OVER (PARTITION BY utt)),
named AS (SELECT utt, x, row_number() OVER (PARTITION BY utt ORDER BY x.k) - 1 AS cluster FROM last)
SELECT utt, k * 100 AS start, k * 100 + 100 AS stop, cluster FROM (SELECT utt, cluster, unnest(x.own) AS k FROM named)"""


ORACLES = {
    "gmm_train_stats": f"{_L} SELECT mix, CAST(d AS INTEGER) AS d, round(mean, 5) + 0.0 AS mean, round(var, 5) + 0.0 AS var, round(log_w, 5) + 0.0 AS log_w FROM m",
    "gmm_component_logdens": f"{_Q} SELECT utt, frame, CAST(mix AS INTEGER) AS mix, round(q, 4) + 0.0 AS q FROM q",
    "gmm_posteriors": f"{_Q} SELECT utt, frame, CAST(mix AS INTEGER) AS mix, round(p, 5) + 0.0 AS p FROM p",
    "gmm_score": f"{_Q} SELECT utt, round(avg(loglik), 4) + 0.0 AS score FROM l GROUP BY utt",
    "gmm_topm": f"{_Q} SELECT utt, frame, CAST(row_number() OVER w - 1 AS INTEGER) AS rank, CAST(mix AS INTEGER) AS mix FROM q WINDOW w AS (PARTITION BY utt, frame ORDER BY q DESC, mix) QUALIFY row_number() OVER w <= 3",
    "gmm_argmax": f"{_Q} SELECT utt, frame, CAST(mix AS INTEGER) AS mix FROM q QUALIFY row_number() OVER (PARTITION BY utt, frame ORDER BY q DESC, mix) = 1",
    "gmm_score_models": f"{_SCORES} SELECT utt, model, round(score, 4) + 0.0 AS score FROM sc",
    "gmm_score_shortfall": f"""{_SCORES.replace('al AS (SELECT model, utt, frame, q FROM tq', 'al AS (SELECT model, utt, frame, q FROM tq QUALIFY q >= max(q) OVER (PARTITION BY model, utt, frame) - 1')}
      SELECT utt, model, round(score, 4) + 0.0 AS score FROM sc""",
    "lid_pair_decision": f"{_SCORES} SELECT utt, split_part(model, '_', 1) AS language, round(sum(CASE WHEN model LIKE '%\\_m' ESCAPE '\\' THEN score ELSE -score END), 4) + 0.0 AS score FROM sc WHERE model <> 'background' GROUP BY ALL",
    "suff_stats": f"{_SUFF} SELECT utt, CAST(mix AS INTEGER) AS mix, round(ec, 4) + 0.0 AS ec, CAST(d AS INTEGER) AS d, round(f, 4) + 0.0 AS f FROM s JOIN e USING (utt, mix)",
    "map_adapt": f"{_MAP} SELECT utt, CAST(mix AS INTEGER) AS mix, CAST(d AS INTEGER) AS d, round(v, 4) + 0.0 AS v FROM a",
    "gsv_expand": f"""{_MAP}, t AS (SELECT utt, sum(ec) AS total FROM e GROUP BY utt)
      SELECT utt, CAST(1 + mix * 64 + d AS INTEGER) AS d, round((v - mu) * sqrt(ec / total) / sqrt(var), 4) + 0.0 AS v FROM a JOIN t USING (utt) UNION ALL SELECT DISTINCT utt, 0, 0.0 FROM a""",
    "gsv_nap": f"""{_MAP}, k AS (SELECT sqrt(count(*) + 1) AS root FROM m), t AS (SELECT utt, sum(ec) AS total FROM e GROUP BY utt),
      x AS (SELECT a.utt, 1 + a.mix * 64 + a.d AS d, (a.v - a.mu) / sqrt(a.var) * exp(0.5 * m.log_w) AS x, sqrt(a.ec / t.total) * exp(-0.5 * m.log_w) AS share FROM a JOIN m ON m.mix = a.mix AND m.d = a.d JOIN t USING (utt)
        UNION ALL SELECT DISTINCT utt, 0, 0.0, 1.0 FROM a),
      y AS (SELECT utt, d, share, x - sum(x / root) OVER (PARTITION BY utt) / root AS x FROM x CROSS JOIN k),
      z AS (SELECT utt, d, share, x - sum(x * CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END / root) OVER (PARTITION BY utt) * CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END / root AS x FROM y CROSS JOIN k)
      SELECT utt, CAST(d AS INTEGER) AS d, round(x * share, 4) + 0.0 AS v FROM z""",
    "nap_project": f"""WITH {V.LONG}, a AS (SELECT utt, frame, d, v - sum(v / 8) OVER w / 8 AS v FROM long WINDOW w AS (PARTITION BY utt, frame)),
      b AS (SELECT utt, frame, d, v - sum(v * CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END / 8) OVER w * CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END / 8 AS v FROM a WINDOW w AS (PARTITION BY utt, frame))
      SELECT utt, frame, CAST(d AS INTEGER) AS d, round(v - sum(CASE WHEN d < 16 THEN v / 4 ELSE 0 END) OVER (PARTITION BY utt, frame) * CASE WHEN d < 16 THEN 0.25 ELSE 0 END, 5) + 0.0 AS v FROM b""",
    "ip_score": f"{_TRIALS} SELECT model, test, round(score, 4) + 0.0 AS score FROM tr",
    "znorm": f"{_TRIALS}, co AS (SELECT * FROM tr WHERE test // 100000 <> model), {_normed('tr', 'co', 'model', 'zn')} SELECT model, test, round(score, 4) + 0.0 AS score FROM zn",
    "tnorm": f"{_TRIALS}, {_normed('tr', 'tr', 'test', 'tn')} SELECT model, test, round(score, 4) + 0.0 AS score FROM tn",
    "ztnorm": f"{_TRIALS}, {_normed('tr', 'tr', 'model', 'zn')}, {_normed('zn', 'zn', 'test', 'zt')} SELECT model, test, round(score, 4) + 0.0 AS score FROM zt",
    "t2_1d_argmax": f"{_SPLIT} SELECT utt, i, round(t2, 5) + 0.0 AS value FROM k QUALIFY row_number() OVER (PARTITION BY utt ORDER BY t2 DESC, i) = 1",
    "bic_1d_delta": f"{_SPLIT} SELECT utt, i, round(bic, 5) + 0.0 AS bic FROM k",
    "bic_summary": f"{_SPLIT} SELECT utt, count(*) AS n, round(avg(bic), 5) + 0.0 AS mean, round(stddev_pop(bic), 5) + 0.0 AS deviation, round(avg(CASE WHEN bic > 0 THEN 1.0::DOUBLE ELSE 0 END), 5) + 0.0 AS share FROM k GROUP BY utt",
    "cluster_pair_bic": f"""WITH {V.SIGNALS}, g AS (SELECT utt, i // 12 AS seg, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM signals GROUP BY ALL),
      p AS (SELECT a.utt, a.seg AS a, b.seg AS b, a.n AS n1, a.s AS s1, a.q AS q1, b.n AS n2, b.s AS s2, b.q AS q2, a.n + b.n AS n, a.s + b.s AS s, a.q + b.q AS q FROM g a JOIN g b ON a.utt = b.utt AND a.seg < b.seg)
      SELECT utt, a, b, round(n / 2.0::DOUBLE * ln(greatest(q / n - (s / n) * s / n, 0) + 1e-6) - n1 / 2.0::DOUBLE * ln(greatest(q1 / n1 - (s1 / n1) * s1 / n1, 0) + 1e-6)
        - n2 / 2.0::DOUBLE * ln(greatest(q2 / n2 - (s2 / n2) * s2 / n2, 0) + 1e-6) - ln(n), 5) + 0.0 AS bic FROM p""",
    "ncc_lag": f"{_LAGS} SELECT utt, frame, CAST(lag AS INTEGER) AS lag, round(c, 5) + 0.0 AS c FROM c",
    "peak_pick": f"{_PEAKS} SELECT utt, frame, k FROM pk",
    "parabolic_peak": f"""{_PEAKS}, s AS (SELECT *, (l + r) / 2 - c AS bend, (r - l) / 2 AS slope FROM pk), h AS (SELECT *, CASE WHEN abs(bend) > 1e-9 THEN -slope / (2 * bend) ELSE 0 END AS shift FROM s)
      SELECT utt, frame, k, round(k + shift, 4) + 0.0 AS place, round(c + slope * shift / 2, 4) + 0.0 AS height FROM h""",
    "itakura": f"""{_NCC}, r AS (SELECT utt, frame, sum(x * x) AS r0 FROM fr GROUP BY ALL), s AS (SELECT a.utt, a.frame, sum(a.x * b.x) AS r1 FROM fr a JOIN fr b ON a.utt = b.utt AND a.frame = b.frame AND b.k = a.k + 1 GROUP BY ALL)
      SELECT utt, frame, round((r0 - 0.8::DOUBLE * r1) / (r0 - r1 * r1 / r0), 5) + 0.0 AS distance FROM r JOIN s USING (utt, frame)""",
    "lpc": f"{_LPC} SELECT utt, frame, round(a1, 5) + 0.0 AS a1, round(a2, 5) + 0.0 AS a2, round(gain / (r0 + 1e-9), 5) + 0.0 AS gain FROM lpc",
    "stationarity": f"""{_LPC}, pair AS (SELECT a.utt, a.frame, a.gain > 0 AND b.gain > 0 AS heard, a.rms AS was, b.rms AS now, b.gain,
  (1 + a.a1 ** 2 + a.a2 ** 2) * b.r0 + 2 * (a.a1 + a.a1 * a.a2) * b.r1 + 2 * a.a2 * b.r2 AS err FROM lpc a JOIN lpc b ON a.utt = b.utt AND b.frame = a.frame + 1)
SELECT utt, frame, round(CASE WHEN heard THEN 0.2 / (err / gain - 0.8) ELSE 0 END, 4) + 0.0 AS stationarity, round(CASE WHEN heard AND was > 0 THEN now / was ELSE 0 END, 4) + 0.0 AS rms_ratio FROM pair""",
    "pitch_window": f"""{_NCC}, y AS (SELECT utt, frame, k, pow(0.5 - 0.5 * cos({2 * math.pi}::DOUBLE * (k + 0.5) / 31), 4) * (lead(x) OVER (PARTITION BY utt, frame ORDER BY k) - 0.4::DOUBLE * x) AS y FROM fr)
      SELECT utt, frame, round(sum(y * y), 4) + 0.0 AS energy FROM y WHERE k < 31 GROUP BY ALL""",
    "pitch_rms": f"{_NCC} SELECT utt, frame, round(sqrt(sum((x * (0.5 - 0.5 * cos({2 * math.pi}::DOUBLE * (k + 0.5) / 32))) ** 2) / 32), 5) + 0.0 AS rms FROM fr GROUP BY ALL",
    "t2_3d_argmax": f"{_THREE} SELECT utt, i, round(t2, 4) + 0.0 AS value FROM k QUALIFY row_number() OVER (PARTITION BY utt ORDER BY t2 DESC, i) = 1",
    "cluster_scalar": _clustered("bic < 0"),
    "cluster_scalar_bounded": _clustered("len(c) > 2 AND (bic < 0 OR len(c) > 3)"),
    "segment_scalar": f"{_SEGMENT} SELECT utt, start, coalesce(lead(start) OVER (PARTITION BY utt ORDER BY start), last + 1) AS stop FROM starts",
    "pitch_path": f"{_PATH} SELECT utt, frame, round(CASE WHEN voiced THEN 2000 / (lag + 0.25::DOUBLE) ELSE 0 END, 5) + 0.0 AS f0, round(CASE WHEN voiced THEN peak ELSE u END, 5) + 0.0 AS peak, rms FROM bw JOIN m USING (utt, frame)",
    "pipeline_full": f"""WITH {V.LONG.replace(', long AS', ', raw AS')}, long AS (SELECT utt, frame, d, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-6) AS v FROM raw WINDOW w AS (PARTITION BY utt, d)),
      {_Q.split('unnest(base) AS v FROM frames), ')[1]},
      b AS (SELECT utt, frame, mix FROM q QUALIFY row_number() OVER (PARTITION BY utt, frame ORDER BY q DESC, mix) = 1)
      SELECT utt, count(*) AS n, round(avg(loglik), 4) + 0.0 AS score, CAST(sum(CASE WHEN mix = utt THEN 1 ELSE 0 END) AS BIGINT) AS own FROM l JOIN b USING (utt, frame) GROUP BY utt""",
}
