"""Queries of feature frames, speech activity and intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import features as X
from ..operators import intervals as I
from ..operators import sad as D
from ..sources import files
from . import views as V
from .signal_queries import rounded


def _long(df, name, digits=5):
    return rounded(df.select("utt", "frame", F.posexplode(name).alias("d", "v")), "v", digits=digits)


def _deltas(spark, sf_dir):
    return X.regression(V.frames(spark, sf_dir), 2)


def _sad(spark, sf_dir):
    """Signals over a threshold, as labels of frames."""
    return V.signals(spark, sf_dir).select("utt", F.col("i").alias("frame"), F.when(F.col("x") > 60, 1).otherwise(0).alias("sad"), "x")


def _energies(spark, sf_dir):
    return V.big(spark, sf_dir).select("utt", F.col("i").alias("frame"), F.col("x").alias("energy"))


def _shifted(spark, sf_dir):
    """Energies whose level falls by 1,800 once the detector adapts, so that its floor jumps."""
    return _energies(spark, sf_dir).withColumn("energy", F.col("energy") + F.when(F.col("frame") < 510, 2000).otherwise(200))


def _marks(spark, sf_dir):
    return V.signals(spark, sf_dir).where("x > 300").select("utt", (F.col("i") * 0.01).alias("start_s"), (F.col("x") / 2000).alias("dur_s"))


def _lengths(spark, sf_dir):
    return V.signals(spark, sf_dir).groupBy("utt").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark, sf_dir):
    return I.runs(_sad(spark, sf_dir), "sad").where("label = 1")


def _others(spark, sf_dir):
    return V.signals(spark, sf_dir).where("x > 250").select("utt", F.col("i").alias("start"), (F.col("i") + 1 + F.floor(F.col("x") / 30)).cast("long").alias("stop"))


def _scores(spark, sf_dir):
    """Three scores for each sample, as if of three models."""
    own = V.signals(spark, sf_dir)
    return own.select("utt", F.col("i").alias("frame"), F.posexplode(F.array(F.col("x") / 50, 100 / (F.col("x") + 10), F.abs(F.col("x") - 80) / 40)).alias("model", "score"))


def _turns(spark, sf_dir):
    own = V.table(spark, sf_dir, "conversations")
    return own.select(F.col("conv_id").alias("utt"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("stop"), F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("label"))


def _user_marks(spark, sf_dir):
    own = V.signals(spark, sf_dir).groupBy("utt").agg(F.count(F.lit(1)).alias("n"))
    return own.select("utt", F.when(F.col("utt") % 2 == 0, "SnsS").otherwise("nnSSxs").alias("marks"))


def _algebra(spark, sf_dir):
    """One number of each vector operation, over a frame's first 8 and last 8 features."""
    a, b = F.slice("base", 1, 8), F.slice("base", 57, 8)
    out = V.frames(spark, sf_dir).select(
        "utt", "frame", A.mean(a).alias("mean"), A.deviation(a, 1e-6).alias("deviation"), A.inner(a, b).alias("inner"), A.total(A.add(a, b)).alias("added"),
        A.total(A.divide(a, A.shift(A.multiply(b, b), F.lit(1.0)))).alias("divided"), A.total(A.scale(A.subtract(a, b), F.lit(2.0))).alias("scaled"),
        A.total(A.add_diagonal(A.outer(a, b), 8, F.lit(0.5))).alias("outer"), A.total(A.constant(F.lit(1.5), F.size(a))).alias("constant"),
    )
    return rounded(out, "mean", "deviation", "inner", "added", "divided", "scaled", "outer")


QUERIES = {
    "feat_delta": lambda spark, sf_dir: _long(_deltas(spark, sf_dir), "delta"),
    "feat_delta2point": lambda spark, sf_dir: _long(X.difference(V.frames(spark, sf_dir), 1), "delta"),
    "feat_accel": lambda spark, sf_dir: _long(X.regression(_deltas(spark, sf_dir), 2, "delta", "accel"), "accel"),
    "feat_sdc": lambda spark, sf_dir: _long(X.shifted_deltas(X.difference(V.frames(spark, sf_dir).withColumn("base", F.slice("base", 1, 7)), 1), 3, 7), "sdc"),
    "feat_rasta": lambda spark, sf_dir: _long(X.rasta(V.frames(spark, sf_dir)), "base"),
    "feat_norm": lambda spark, sf_dir: _long(X.normalise(V.frames(spark, sf_dir)), "base"),
    "feat_select_outfeat": lambda spark, sf_dir: _long(X.select_features(_deltas(spark, sf_dir), "df"), "features"),
    "feat_transposed": lambda spark, sf_dir: rounded(X.transposed(V.frames(spark, sf_dir), 2, 6, "base").select("utt", "d", F.posexplode("values").alias("k", "v")), "v"),
    "feat_dims": lambda spark, sf_dir: _deltas(spark, sf_dir).groupBy("utt").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("base")).alias("base_dim"), F.max(F.size("base") + F.size("delta")).alias("total_dim"), (F.count(F.lit(1)) * 0.01).alias("seconds")
    ),
    "sad_xtalk": lambda spark, sf_dir: D.energy_sad(_energies(spark, sf_dir), 2.0, 12.0),
    "sad_xtalk_shift": lambda spark, sf_dir: D.energy_sad(_shifted(spark, sf_dir), 2.0, 12.0),
    "sad_median": lambda spark, sf_dir: D.energy_sad(_energies(spark, sf_dir), 2.0, 12.0, 11),
    "sad_apply": lambda spark, sf_dir: rounded(X.apply_sad(_sad(spark, sf_dir)).select("utt", "frame", "x"), "x"),
    "sad_no_speech": lambda spark, sf_dir: D.no_speech(_sad(spark, sf_dir)),
    "sad_marks_to_frames": lambda spark, sf_dir: D.marks_to_frames(_marks(spark, sf_dir), 10.0, _lengths(spark, sf_dir)),
    "sad_mark_durations_to_frames": lambda spark, sf_dir: D.marks_to_frames(_marks(spark, sf_dir), 10.0, _lengths(spark, sf_dir), round_duration=True),
    "sad_frames_to_marks": lambda spark, sf_dir: D.marks_text(_runs(spark, sf_dir), 10.0, F.lit("speech")),
    "sad_label_pad": lambda spark, sf_dir: D.labels_for(_lengths(spark, sf_dir), _sad(spark, sf_dir).where("frame < 60").select("utt", "frame", "sad"), sloppy=True),
    "sad_label_lines": lambda spark, sf_dir: files.label_lines(_sad(spark, sf_dir)),
    "segment_marks": lambda spark, sf_dir: files.segment_marks(_runs(spark, sf_dir), 10.0),
    "segment_marks_audacity": lambda spark, sf_dir: files.segment_marks(_runs(spark, sf_dir), 10.0, audacity=True),
    "sad_string": lambda spark, sf_dir: D.speech_string(_sad(spark, sf_dir), 32),
    "sad_user_marks": lambda spark, sf_dir: D.and_user_marks(_sad(spark, sf_dir).select("utt", "frame", "sad"), _user_marks(spark, sf_dir), 10),
    "vec_algebra": lambda spark, sf_dir: _algebra(spark, sf_dir),
    "score_smooth": lambda spark, sf_dir: rounded(D.smooth_scores(_scores(spark, sf_dir), 10), "score"),
    "segments_argmax_rle": lambda spark, sf_dir: I.runs(D.best_model(_scores(spark, sf_dir))),
    "segments_from_sad": _runs,
    "segments_gap_merge": lambda spark, sf_dir: I.merged(_runs(spark, sf_dir), 3, 4),
    "intervals_subtract": lambda spark, sf_dir: I.subtract(_runs(spark, sf_dir), _others(spark, sf_dir)),
    "intervals_intersect": lambda spark, sf_dir: I.intersect(_runs(spark, sf_dir), _others(spark, sf_dir)),
    "intervals_coalesce": lambda spark, sf_dir: I.coalesced(_turns(spark, sf_dir)),
}

_L = f"WITH {V.LONG}"
_CLAMP = "PARTITION BY utt, d ORDER BY frame"


def _at(value, shift, over="w"):
    if shift >= 0:
        return f"coalesce(lead({value}, {shift}) OVER {over}, last_value({value}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"coalesce(lag({value}, {-shift}) OVER {over}, first_value({value}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _slope(value):
    return f"(1 * ({_at(value, 1)} - {_at(value, -1)}) + 2 * ({_at(value, 2)} - {_at(value, -2)})) / 10.0::DOUBLE"


_W = f"WINDOW w AS ({_CLAMP})"
_DELTA = f"{_L}, delta AS (SELECT utt, frame, d, {_slope('v')} AS v FROM long {_W})"
_SAD = f"WITH {V.SIGNALS}, sad AS (SELECT utt, i AS frame, CASE WHEN x > 60 THEN 1 ELSE 0 END AS sad, x FROM signals)"
_RUNS = f"""{_SAD}, edge AS (SELECT *, CASE WHEN sad IS DISTINCT FROM lag(sad) OVER (PARTITION BY utt ORDER BY frame) THEN 1 ELSE 0 END AS new FROM sad),
grp AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY frame) AS g FROM edge),
runs AS (SELECT utt, min(frame) AS start, max(frame) + 1 AS stop, any_value(sad) AS label FROM grp GROUP BY utt, g)"""
_SWEEP = f"""{_RUNS}, a AS (SELECT utt, start, stop FROM runs WHERE label = 1), b AS (SELECT utt, i AS start, i + 1 + CAST(floor(x / 30) AS BIGINT) AS stop FROM signals WHERE x > 250),
pt AS (SELECT utt, start AS t FROM a UNION SELECT utt, stop FROM a UNION SELECT utt, start FROM b UNION SELECT utt, stop FROM b),
pc AS (SELECT utt, t AS start, lead(t) OVER (PARTITION BY utt ORDER BY t) AS stop FROM pt),
cv AS (SELECT pc.*, EXISTS (SELECT 1 FROM a WHERE a.utt = pc.utt AND a.start <= pc.start AND a.stop >= pc.stop) AS ina,
  EXISTS (SELECT 1 FROM b WHERE b.utt = pc.utt AND b.start <= pc.start AND b.stop >= pc.stop) AS inb FROM pc WHERE stop IS NOT NULL)"""


def _touching(wanted):
    return f"""{_SWEEP}, k AS (SELECT * FROM cv WHERE {wanted}), n AS (SELECT *, CASE WHEN start = lag(stop) OVER (PARTITION BY utt ORDER BY start) THEN 0 ELSE 1 END AS new FROM k),
      g AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY start) AS g FROM n) SELECT utt, min(start) AS start, max(stop) AS stop FROM g GROUP BY utt, g"""


def _marks_sql(stop):
    return f"""WITH {V.SIGNALS}, n AS (SELECT utt, count(*) AS n FROM signals GROUP BY utt), m AS (SELECT utt, i * 0.01::DOUBLE AS s, x / 2000 AS d FROM signals WHERE x > 300),
      f AS (SELECT utt, floor(s * 1000 / 10 + 0.5) AS a, {stop} AS b FROM m), g AS (SELECT utt, unnest(generate_series(0, n - 1)) AS frame FROM n)
      SELECT utt, frame, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.utt = g.utt AND g.frame BETWEEN f.a AND f.b) THEN 1 ELSE 0 END AS sad FROM g"""


def rasta_sql(source, name):
    """The recursion as a sum over all frames before."""
    return f"""{name}_u AS (SELECT utt, d, frame, 0.2::DOUBLE * {_at('v', 2)} + 0.1::DOUBLE * {_at('v', 1)} - 0.1::DOUBLE * {_at('v', -1)} - 0.2::DOUBLE * {_at('v', -2)} AS u,
      0.2::DOUBLE * ({_at('v', 1)} - v) AS e FROM {source} {_W}), {name}_z AS (SELECT utt, d, frame, u FROM {name}_u UNION ALL SELECT utt, d, -1, e FROM {name}_u WHERE frame = 0),
    {name} AS MATERIALIZED (SELECT a.utt, a.frame, a.d, sum(b.u * pow(0.98::DOUBLE, a.frame - b.frame)) AS v
      FROM {name}_z a JOIN {name}_z b ON a.utt = b.utt AND a.d = b.d AND b.frame <= a.frame WHERE a.frame >= 0 GROUP BY ALL)"""


def energy_sql(source, least, threshold):
    """The detector without jumps, frame by frame."""
    return f"""s AS (
  SELECT utt, i, x, CASE WHEN x < {least} THEN 0 ELSE 1 END AS seen, x AS lvl, CASE WHEN x < {least} THEN NULL ELSE x + 0.002166062::DOUBLE END AS flr, 0 AS sad FROM {source} WHERE i = 0
  UNION ALL SELECT b.utt, b.i, b.x, s.seen + CASE WHEN b.x < {least} THEN 0 ELSE 1 END,
    CASE WHEN b.x < {least} THEN s.lvl WHEN s.seen = 0 THEN b.x ELSE 0.9::DOUBLE * s.lvl + 0.1::DOUBLE * b.x END,
    CASE WHEN b.x < {least} THEN s.flr WHEN s.seen = 0 THEN b.x + 0.002166062::DOUBLE ELSE least(s.flr, 0.9::DOUBLE * s.lvl + 0.1::DOUBLE * b.x) + 0.002166062::DOUBLE END,
    CASE WHEN b.x >= {least} AND s.seen > 0 AND b.x - least(s.flr, 0.9::DOUBLE * s.lvl + 0.1::DOUBLE * b.x) > {threshold} THEN 1 ELSE 0 END
  FROM s JOIN {source} b ON b.utt = s.utt AND b.i = s.i + 1)"""


_XTALK = f"WITH RECURSIVE {V.BIG}, {energy_sql('big', 2, 12)}"
# Five labels that are decided and six raw ones from here on; past the end the last one repeats.
_MEDIAN = f"""{_XTALK}, ah AS MATERIALIZED (SELECT utt, i, sad, sum(sad) OVER w + (6 - count(*) OVER w) * last_value(sad) OVER (PARTITION BY utt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ahead
  FROM s WINDOW w AS (PARTITION BY utt ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
md AS (SELECT utt, 4::BIGINT AS i, list(sad ORDER BY i) AS decided FROM ah WHERE i < 5 GROUP BY utt HAVING count(*) = 5
  UNION ALL SELECT ah.utt, ah.i, list_append(md.decided[2:], CASE WHEN list_sum(md.decided) + ah.ahead > 5 THEN 1 ELSE 0 END) FROM md JOIN ah ON ah.utt = md.utt AND ah.i = md.i + 1)"""

_SHIFT = f"""WITH RECURSIVE {V.BIG}, e AS (SELECT utt, i, x + CASE WHEN i < 510 THEN 2000 ELSE 200 END AS x FROM big), s AS (
  SELECT utt, i, x AS lvl, x + 0.002166062::DOUBLE AS flr, list_transform(range(10), lambda k: x) AS hist, 0 AS gaps, 0::BIGINT AS jumped, 0 AS sad FROM e WHERE i = 0
  UNION ALL SELECT utt, i, lvl, f + 0.002166062::DOUBLE, list_transform(range(10), lambda k: CASE WHEN k = i % 10 THEN f ELSE hist[k + 1] END), gaps, jumped, CASE WHEN x - f > 12 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN jump AND gaps < 20 THEN old ELSE m END AS f
    FROM (SELECT utt, i, x, lvl, m, old, jump, hist, CASE WHEN NOT jump THEN gaps WHEN i - jumped = 1 THEN gaps + 1 ELSE 0 END AS gaps, CASE WHEN jump THEN i ELSE jumped END AS jumped
      FROM (SELECT *, i >= 500 AND abs(m - old) > 100 AS jump
        FROM (SELECT e.utt, e.i, e.x, 0.9::DOUBLE * s.lvl + 0.1::DOUBLE * e.x AS lvl, least(s.flr, 0.9::DOUBLE * s.lvl + 0.1::DOUBLE * e.x) AS m, s.hist[e.i % 10 + 1] AS old, s.hist, s.gaps, s.jumped
          FROM s JOIN e ON e.utt = s.utt AND e.i = s.i + 1)))))"""

ORACLES = {
    "feat_transposed": f"WITH {V.LONG} SELECT utt, CAST(d AS INTEGER) AS d, CAST(frame - 2 AS INTEGER) AS k, round(v, 5) + 0.0 AS v FROM long WHERE frame >= 2 AND frame < 6",
    "sad_xtalk_shift": f"{_SHIFT} SELECT utt, i AS frame, sad FROM s",
    "feat_delta": f"{_DELTA} SELECT utt, frame, CAST(d AS INTEGER) AS d, round(v, 5) + 0.0 AS v FROM delta",
    "feat_delta2point": f"{_L} SELECT utt, frame, CAST(d AS INTEGER) AS d, round({_at('v', 1)} - {_at('v', -1)}, 5) + 0.0 AS v FROM long {_W}",
    "feat_accel": f"{_DELTA} SELECT utt, frame, CAST(d AS INTEGER) AS d, round({_slope('v')}, 5) + 0.0 AS v FROM delta {_W}",
    "feat_sdc": f"""{_L}, delta AS (SELECT utt, frame, d, {_at('v', 1)} - {_at('v', -1)} AS v FROM long WHERE d < 7 {_W})
      {' UNION ALL '.join(f"SELECT utt, frame, CAST(d + {7 * (j + 3)} AS INTEGER) AS d, round({_at('v', 3 * j)}, 5) + 0.0 AS v FROM delta {_W}" for j in range(-3, 4))}""",
    "feat_rasta": f"{_L}, {rasta_sql('long', 'r')} SELECT utt, frame, CAST(d AS INTEGER) AS d, round(v, 5) + 0.0 AS v FROM r",
    "feat_norm": f"{_L} SELECT utt, frame, CAST(d AS INTEGER) AS d, round((v - avg(v) OVER p) / greatest(stddev_pop(v) OVER p, 1e-6), 5) + 0.0 AS v FROM long WINDOW p AS (PARTITION BY utt, d)",
    "feat_select_outfeat": f"{_DELTA} SELECT utt, frame, CAST(d AS INTEGER) AS d, round(v, 5) + 0.0 AS v FROM delta UNION ALL SELECT utt, frame, CAST(d + 64 AS INTEGER), round(v, 5) + 0.0 FROM long",
    "feat_dims": f"WITH {V.FRAMES} SELECT utt, count(*) AS n, CAST(max(len(base)) AS INTEGER) AS base_dim, CAST(2 * max(len(base)) AS INTEGER) AS total_dim, count(*) * 0.01::DOUBLE AS seconds FROM frames GROUP BY utt",
    "sad_xtalk": f"{_XTALK} SELECT utt, i AS frame, sad FROM s",
    "sad_median": f"{_MEDIAN} SELECT utt, i AS frame, sad FROM ah WHERE i < 5 UNION ALL SELECT utt, i, decided[5] FROM md WHERE i >= 5",
    "sad_label_lines": f"{_SAD} SELECT utt, frame, CAST(sad AS VARCHAR) AS line FROM sad",
    "segment_marks": f"{_RUNS} SELECT utt, start, printf('int %.2f %.2f', start * 0.01::DOUBLE, stop * 0.01::DOUBLE - start * 0.01::DOUBLE) AS line FROM runs WHERE label = 1",
    "segment_marks_audacity": f"{_RUNS} SELECT utt, start, printf('%.2f %.2f int', start * 0.01::DOUBLE, stop * 0.01::DOUBLE) AS line FROM runs WHERE label = 1",
    "sad_apply": f"{_SAD} SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY frame) - 1 AS frame, round(x, 5) + 0.0 AS x FROM sad WHERE sad = 1",
    "sad_no_speech": f"{_SAD} SELECT utt, max(sad) = 0 AS no_speech FROM sad GROUP BY utt",
    "sad_marks_to_frames": _marks_sql("floor((s + d) * 1000 / 10 + 0.5)"),
    "sad_mark_durations_to_frames": _marks_sql("floor(s * 1000 / 10 + 0.5) + floor(d * 1000 / 10 + 0.5)"),
    "sad_frames_to_marks": f"{_RUNS} SELECT utt, start, printf('speech %.2f %.2f', start * 0.01::DOUBLE, (stop - start) * 0.01::DOUBLE) AS line FROM runs WHERE label = 1",
    "sad_label_pad": f"{_SAD} SELECT utt, frame, CASE WHEN frame < 60 THEN sad ELSE 0 END AS sad FROM sad",
    "sad_string": f"{_SAD} SELECT utt, frame // 32 AS chunk, string_agg(CASE WHEN sad = 1 THEN 's' ELSE 'n' END, '' ORDER BY frame) AS marks FROM sad GROUP BY ALL",
    "sad_user_marks": f"{_SAD} SELECT utt, frame, CASE WHEN upper(substr(CASE WHEN utt % 2 = 0 THEN 'SnsS' ELSE 'nnSSxs' END, CAST(frame // 10 + 1 AS INTEGER), 1)) = 'S' THEN sad ELSE 0 END AS sad FROM sad",
    "vec_algebra": f"""WITH {V.LONG}, p AS (SELECT a.utt, a.frame, a.v AS a, b.v AS b FROM long a JOIN long b ON a.utt = b.utt AND a.frame = b.frame AND b.d = a.d + 56 WHERE a.d < 8)
      SELECT utt, frame, round(avg(a), 5) + 0.0 AS mean, round(greatest(stddev_pop(a), 1e-6), 5) + 0.0 AS deviation, round(sum(a * b), 5) + 0.0 AS "inner", round(sum(a + b), 5) + 0.0 AS added,
        round(sum(a / (b * b + 1)), 5) + 0.0 AS divided, round(sum(2 * (a - b)), 5) + 0.0 AS scaled, round(sum(a) * sum(b) + 4, 5) + 0.0 AS "outer", 12.0::DOUBLE AS "constant" FROM p GROUP BY utt, frame""",
    "score_smooth": f"""WITH {V.SIGNALS}, s AS (SELECT utt, i AS frame, unnest([0, 1, 2]) AS model, unnest([x / 50, 100 / (x + 10), abs(x - 80) / 40]) AS score FROM signals),
      m AS (SELECT *, count(*) OVER w AS c, avg(score) OVER w AS a FROM s WINDOW w AS (PARTITION BY utt, model ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)),
      f AS (SELECT utt, frame, model, CASE WHEN c = 10 THEN a WHEN frame < 4 THEN first_value(CASE WHEN c = 10 THEN a END IGNORE NULLS) OVER v ELSE last_value(CASE WHEN c = 10 THEN a END IGNORE NULLS) OVER v END AS score
        FROM m WINDOW v AS (PARTITION BY utt, model ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT utt, frame, model, round(score - avg(score) OVER (PARTITION BY utt, frame), 5) + 0.0 AS score FROM f""",
    "segments_argmax_rle": f"""WITH {V.SIGNALS}, s AS (SELECT utt, i AS frame, CASE WHEN x / 50 >= greatest(100 / (x + 10), abs(x - 80) / 40) THEN 0 WHEN 100 / (x + 10) >= abs(x - 80) / 40 THEN 1 ELSE 2 END AS label FROM signals),
      e AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY utt ORDER BY frame) THEN 1 ELSE 0 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY frame) AS g FROM e)
      SELECT utt, min(frame) AS start, max(frame) + 1 AS stop, any_value(label) AS label FROM g GROUP BY utt, g""",
    "segments_from_sad": f"{_RUNS} SELECT utt, start, stop, label FROM runs WHERE label = 1",
    "segments_gap_merge": f"""{_RUNS}, r AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY utt ORDER BY start) < 3 THEN 0 ELSE 1 END AS fresh FROM runs WHERE label = 1),
      m AS (SELECT *, sum(fresh) OVER (PARTITION BY utt ORDER BY start) AS h FROM r) SELECT utt, min(start) AS start, max(stop) AS stop FROM m GROUP BY utt, h HAVING max(stop) - min(start) >= 4""",
    "intervals_subtract": _touching("ina AND NOT inb"),
    "intervals_intersect": _touching("ina AND inb"),
    "intervals_coalesce": """WITH t AS (SELECT conv_id AS utt, turn AS start, turn + 1 AS stop, CASE WHEN role = 'system' THEN 'user' ELSE role END AS label FROM conversations),
      n AS (SELECT *, CASE WHEN lag(stop) OVER w = start AND lag(label) OVER w IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY utt ORDER BY start)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY start) AS g FROM n) SELECT utt, min(start) AS start, max(stop) AS stop, label FROM g GROUP BY utt, g, label""",
}
