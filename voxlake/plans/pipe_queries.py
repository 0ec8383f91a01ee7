"""Queries of whole recipes over signals, and their SQL."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..operators import gmm as G
from ..operators import pipes as R
from . import views as V
from .feature_queries import _at, _slope, energy_sql, rasta_sql
from .signal_queries import rounded
from .spectral_queries import CEPSTRA

#: The small frames of the spectral queries.
SMALL = {"feat_type": "mfcc", "alpha": "1", "dither": 0, "fb_low": 0, "fb_hi": "4000", "keep_c0": "false", "linear": "true", "num_cep": "5", "win_inc_ms": 1, "win_len_ms": 2, "tgt_num_filt": 7}
BLOCKS = {"pipe_config": {"feat_config": SMALL, "do_rasta": True, "do_delta": True, "delta2point": True, "delta_spread": 1, "do_sdc": True, "sdc_params": [3, 7], "do_feat_norm": True, "outfeat": "fs"}}
SPOKEN = {"feat_config": SMALL, "label_keep": "speech", "label_window": 4, "min_gap_dur": 0.002, "min_seg_dur": 0.002}
SLOPES = {"pipe_config": {"feat_config": SMALL, "do_rasta": "true", "do_delta": "true", "delta_spread": 2, "do_feat_norm": "true", "outfeat": "fd"}}
ENERGY = {"abs_min_energy": -20, "thresh": 0.5}


def _gaussians(centre: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of two Gaussians over five cepstra and their slopes."""
    first = np.arange(10) < 5
    mean = [np.where(first, centre - 1, 0.1 * centre), np.where(first, centre + 1, -0.1 * centre)]
    return np.array([0.4, 0.6]), np.stack(mean), np.stack([np.where(first, 4 + abs(centre), 1.0), np.where(first, 2.0, 0.5)])


CENTRES = {"speech": 0.0, "music": 2.0, "nonspeech": -2.0, "background": 0.5}
MODELS = {name: G.Mixture.of(*_gaussians(c)) for name, c in CENTRES.items()}
CLASSES = {name: MODELS[name] for name in ("speech", "music", "nonspeech")}


def _spoken(spark, sf_dir):
    return R.speech_intervals(V.signals(spark, sf_dir), json.dumps(SPOKEN), CLASSES)


def _identified(spark, sf_dir):
    """Speech by mixtures, normalised features, models against the background's densest Gaussian, and decisions."""
    frames = R.as_base(R.feature_pipe(V.signals(spark, sf_dir), json.dumps(SLOPES), R.by_mixtures(SPOKEN, CLASSES)))
    return G.decide(G.score_models(frames, MODELS["background"], CLASSES, 1), {"speech": ("speech", "nonspeech"), "music": ("music", "nonspeech")})


QUERIES = {
    "feat_pipe": lambda spark, sf_dir: rounded(R.feature_pipe(V.signals(spark, sf_dir), BLOCKS, R.by_energy(ENERGY)).select("utt", "frame", F.posexplode("features").alias("d", "v")), "v", digits=4),
    "gmmsad": _spoken,
    "lid_pipe": lambda spark, sf_dir: rounded(_identified(spark, sf_dir), "score", digits=4),
}

_W = "WINDOW w AS (PARTITION BY utt, d ORDER BY frame)"
_CEPSTRA = f"{CEPSTRA.replace('WITH ', 'WITH RECURSIVE ', 1)}, {rasta_sql('long', 'r')}"
_ROWS = ", ".join(f"('{name}', {k}, {w[k]}, {d}, {mean[k, d]}, {var[k, d]})" for name, c in CENTRES.items() for w, mean, var in [_gaussians(c)] for k in range(2) for d in range(10))
_FD = f"""{_CEPSTRA}, md AS (SELECT name, mix, w::DOUBLE AS w, d, mean::DOUBLE AS mean, var::DOUBLE AS var FROM (VALUES {_ROWS}) AS t(name, mix, w, d, mean, var)),
fd AS MATERIALIZED (SELECT utt, frame, d, v FROM r UNION ALL SELECT utt, frame, d + 5, {_slope('v')} FROM r {_W})"""


def _density(name, source, models):
    """Log density of each Gaussian of some models, its weight included."""
    return f"{name} AS (SELECT utt, frame, name, mix, ln(any_value(w)) - 0.5 * (sum(ln(var)) + 10 * ln(2 * pi()) + sum((v - mean) ** 2 / var)) AS q FROM {source} JOIN md USING (d) WHERE name {models} GROUP BY utt, frame, name, mix)"


_SPOKEN = f"""{_FD}, {_density('lq', 'fd', "<> 'background'")},
sc AS (SELECT utt, frame, name, any_value(top) + ln(sum(exp(q - top))) AS v FROM (SELECT *, max(q) OVER (PARTITION BY utt, frame, name) AS top FROM lq) GROUP BY utt, frame, name),
mv AS (SELECT *, CASE WHEN count(*) OVER x = 4 THEN avg(v) OVER x END AS a FROM sc WINDOW x AS (PARTITION BY utt, name ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)),
sm AS (SELECT utt, frame, name, coalesce(a, CASE WHEN frame < 1 THEN first_value(a IGNORE NULLS) OVER x ELSE last_value(a IGNORE NULLS) OVER x END, v) AS v FROM mv
  WINDOW x AS (PARTITION BY utt, name ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bm AS (SELECT utt, frame, name FROM sm QUALIFY row_number() OVER (PARTITION BY utt, frame ORDER BY v DESC) = 1),
eg AS (SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER (PARTITION BY utt ORDER BY frame) THEN 1 ELSE 0 END AS new FROM bm),
gr AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY frame) AS g FROM eg),
rn AS (SELECT utt, min(frame) AS start, max(frame) + 1 AS stop FROM gr GROUP BY utt, g, name HAVING name = 'speech'),
jn AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY utt ORDER BY start) < 2 THEN 0 ELSE 1 END AS fresh FROM rn),
mg AS (SELECT *, sum(fresh) OVER (PARTITION BY utt ORDER BY start) AS h FROM jn),
iv AS MATERIALIZED (SELECT utt, min(start) AS start, max(stop) AS stop FROM mg GROUP BY utt, h HAVING max(stop) - min(start) >= 2)"""
ORACLES = {
    "feat_pipe": f"""{_CEPSTRA}, dl AS MATERIALIZED (SELECT utt, frame, d, {_at('v', 1)} - {_at('v', -1)} AS v FROM r {_W}),
      en AS MATERIALIZED (SELECT utt, frame AS i, 10 * log10(sum(v * v) + 1e-20) - 40 AS x FROM w GROUP BY utt, frame), {energy_sql('en', -20, 0.5)},
      kp AS (SELECT utt, i AS frame, row_number() OVER (PARTITION BY utt ORDER BY i) - 1 AS new FROM s WHERE sad = 1),
      al AS (SELECT utt, frame, d, v FROM r {' '.join(f"UNION ALL SELECT utt, frame, {5 * (j + 4)} + d, {_at('v', 3 * j)} FROM dl {_W}" for j in range(-3, 4))}),
      ft AS (SELECT al.utt, kp.new AS frame, al.d, al.v FROM al JOIN kp USING (utt, frame))
      SELECT utt, frame, CAST(d AS INTEGER) AS d, round((v - avg(v) OVER p) / greatest(stddev_pop(v) OVER p, 1e-6), 4) + 0.0 AS v FROM ft WINDOW p AS (PARTITION BY utt, d)""",
    "gmmsad": f"{_SPOKEN} SELECT utt, start, stop FROM iv",
    "lid_pipe": f"""{_SPOKEN}, kp AS (SELECT fd.* FROM fd JOIN iv ON iv.utt = fd.utt AND fd.frame >= iv.start AND fd.frame < iv.stop),
      nv AS MATERIALIZED (SELECT utt, frame, d, (v - avg(v) OVER p) / greatest(stddev_pop(v) OVER p, 1e-6) AS v FROM kp WINDOW p AS (PARTITION BY utt, d)), {_density('bq', 'nv', "= 'background'")},
      bb AS (SELECT utt, frame, mix FROM bq QUALIFY row_number() OVER (PARTITION BY utt, frame ORDER BY q DESC, mix) = 1),
      tq AS (SELECT nv.utt, nv.frame, t.name, ln(any_value(b.w)) - 0.5 * (sum(ln(b.var)) + 10 * ln(2 * pi()) + sum((nv.v - t.mean) ** 2 / t.var)) AS q
        FROM bb JOIN nv USING (utt, frame) JOIN md t ON t.d = nv.d AND t.mix = bb.mix JOIN md b ON b.d = nv.d AND b.mix = bb.mix WHERE t.name <> 'background' AND b.name = 'background' GROUP BY nv.utt, nv.frame, t.name),
      av AS (SELECT utt, name, avg(q) AS score FROM tq GROUP BY utt, name)
      SELECT a.utt, a.name AS language, round(a.score - b.score, 4) + 0.0 AS score FROM av a JOIN av b ON b.utt = a.utt AND b.name = 'nonspeech' WHERE a.name <> 'nonspeech'""",
}
