"""Change search against a replay of its rule, in one dimension against SQL, and splits of vectors."""

import duckdb
import numpy as np
import pytest

from voxlake.operators import segment


def replay(x, rule):
    """The rule step by step, everything computed anew for each window; frames counted from 0, ends inclusive."""
    eye = 1e-6 * np.eye(x.shape[1])

    def cov(y):
        m = y.mean(0)
        return y.T @ y / len(y) - np.outer(m, m)

    def t2(start, stop, at):
        a, b, n = x[start : at + 1], x[at + 1 : stop + 1], stop - start + 1
        gap = a.mean(0) - b.mean(0)
        return len(a) * len(b) / n * gap @ np.linalg.inv(cov(x[start : stop + 1]) + eye) @ gap

    def bic(start, stop, at):
        part = lambda y: 0.5 * len(y) * np.linalg.slogdet(cov(y) + eye)[1]
        n, d = stop - start + 1, x.shape[1]
        whole = part(x[start : stop + 1]) - part(x[start : at + 1]) - part(x[at + 1 : stop + 1])
        return whole - 0.5 * rule.weight * (d + d * (d + 1) / 2) * np.log(n)

    end, start, found = len(x) - 1, 0, []
    stop = start + rule.smallest + rule.first
    while stop <= end:
        places = list(range(start + rule.smallest, stop))
        values = [t2(start, stop, k) for k in places]
        at = places[int(np.argmax(values))]
        if end - at < rule.smallest:
            break
        if bic(start, stop, at) > rule.threshold:
            found.append(at)
            start = at + 1
            stop = start + rule.smallest + rule.first
            continue
        stop += rule.growth
        if stop - start + 1 > rule.largest:
            at = start + rule.largest
            if end - at < rule.smallest:
                break
            found.append(at)
            start = at + 1
            stop = start + rule.smallest + rule.first
    return found


def stretches(rng, d, sizes):
    return np.concatenate([rng.normal(size=(n, d)) * (0.5 + rng.random()) + rng.normal(size=d) * 2 for n in sizes])


@pytest.mark.parametrize("d", [1, 3])
def test_search_equals_the_replayed_rule(d):
    rng = np.random.default_rng(d)
    rules = [segment.ChangeRule(), segment.ChangeRule(first=20, largest=90, smallest=7, growth=11), segment.ChangeRule(first=30, largest=60, smallest=10, growth=10, threshold=15.0), segment.ChangeRule(weight=4.0)]
    for rule in rules:
        for sizes in ([700], [200, 300, 150], [30, 40, 50, 700], [10], [126], [125], [1200, 30]):
            x = stretches(rng, d, sizes)
            want = replay(x, rule)
            assert segment.change_points(x, rule) == want
            own, found, most = segment.ChangeSearch(rule), [], 0
            for part in np.array_split(x, 13):
                found += own.push(part)
                most = max(most, len(own.held) - len(part))
            assert found + own.finish() == want and most <= rule.largest + 2 * rule.growth + rule.smallest + rule.first


def test_segments_of_tables(spark):
    rng = np.random.default_rng(8)
    own = {1: stretches(rng, 2, [400, 300, 500]), 2: stretches(rng, 2, [20]), 3: np.zeros((900, 2))}
    rows = [(u, k + 50, [float(v) for v in r]) for u, x in own.items() for k, r in enumerate(x)]
    frames = spark.createDataFrame(rows, "utt long, frame long, base array<double>").repartition(5)
    got = {}
    for r in segment.segment(frames).orderBy("utt", "start").collect():
        got.setdefault(r["utt"], []).append((r["start"], r["stop"]))
    for u, x in own.items():
        cuts = [50, *(50 + k + 1 for k in replay(x, segment.ChangeRule())), 50 + len(x)]
        assert got[u] == list(zip(cuts[:-1], cuts[1:], strict=True))
    assert len(got[1]) >= 3 and got[3][0] == (50, 551)
    assert segment.segment(frames.limit(0)).count() == 0


def test_splits_of_vectors_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(9)
    own = {1: stretches(rng, 3, [60, 90]), 2: rng.normal(size=(11, 3)), 3: rng.normal(size=(9, 3))}
    rows = [(u, k, [float(v) for v in r]) for u, x in own.items() for k, r in enumerate(x)]
    frames = spark.createDataFrame(rows, "utt long, frame long, base array<double>").repartition(5)
    found = segment.vector_splits(frames, 5, size=16)
    got = {(r["utt"], r["i"]): (r["n"], r["n1"], r["t2"]) for r in found.collect()}
    want = {}
    for u, x in own.items():
        inverse = np.linalg.inv(np.cov(x.T, bias=True) + 1e-6 * np.eye(3))
        for k in range(5, len(x) - 4):
            gap = x[:k].mean(0) - x[k:].mean(0)
            want[u, k] = (len(x), k, k * (len(x) - k) / len(x) * gap @ inverse @ gap)
    assert set(got) == set(want)
    for key, (n, n1, t2) in want.items():
        assert got[key][:2] == (n, n1) and got[key][2] == pytest.approx(t2)
    best = {r["utt"]: r["i"] for r in segment.best_split(found, "t2").collect()}
    assert best[1] == max((k for k in want if k[0] == 1), key=lambda k: want[k][2])[1] and set(best) == {1, 2}
    assert segment.vector_splits(frames.limit(0), 5).count() == 0


def test_joining_can_bring_clusters_nearer():
    """The criterion of a joined pair and a third cluster can be below both of theirs, so joining all reciprocal neighbours at once is not the greedy rule."""
    rng = np.random.default_rng(0)
    nearer = 0
    for _ in range(50):
        a, b, c = (segment._stats(rng.normal(size=(60, 2))) for _ in range(3))
        joined = tuple(x + y for x, y in zip(a, b, strict=True))
        nearer += segment.delta_bic(joined, c, 1.0) < min(segment.delta_bic(a, c, 1.0), segment.delta_bic(b, c, 1.0))
    assert nearer > 5


@pytest.mark.parametrize("operator", ["cluster", "segment_intervals"])
def test_frames_of_intervals_are_not_broadcast(spark, operator):
    """A few bytes of intervals hold very many frames, which their size doesn't show."""
    frames = spark.range(2_000).selectExpr("id % 2 as utt", "id div 2 as frame", "array(cast(id % 7 as double)) as base")
    intervals = spark.range(10).selectExpr("id % 2 as utt", "(id div 2) * 200 as start", "(id div 2) * 200 + 200 as stop", "'speech' as label")
    made = segment.cluster(intervals, frames) if operator == "cluster" else segment.segment_intervals(frames, intervals)
    assert {(r["utt"], r["start"]) for r in made.collect()} >= {(k % 2, k // 2 * 200) for k in range(10)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Inner, BuildLeft" not in plan and "Inner, BuildRight" not in plan


def test_frames_meet_every_interval_that_holds_them(spark):
    rng = np.random.default_rng(3)
    size = segment.PART
    own = [(u, int(a), int(a + n)) for u in (1, 2) for a, n in zip(rng.integers(0, 900, 20), [0, 1, size, size + 1, 3 * size, *rng.integers(1, 500, 15)], strict=True)]
    frames = spark.createDataFrame([(u, f) for u in (1, 2) for f in range(1_000)], "utt long, frame long")
    got = segment.within(frames, spark.createDataFrame(own, "utt long, start long, stop long")).select("utt", "start", "stop", "frame").collect()
    assert sorted(map(tuple, got)) == sorted((u, a, b, f) for u, a, b in own for f in range(a, min(b, 1_000)))


def test_clusters_of_parted_and_overlapping_segments(spark):
    """Segments whose sums come in several batches are joined as by their sums at once."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (600, 2)).astype(float) + np.repeat([0, 6, 0], 200)[:, None]
    cut = [(0, 150), (100, 260), (260, 400), (400, 600), (380, 590)]
    frames = spark.createDataFrame([(7, k, r.tolist()) for k, r in enumerate(x)], "utt long, frame long, base array<double>").repartition(3)
    n, s, q = (np.array(c) for c in zip(*(segment._stats(x[a:b]) for a, b in sorted(cut)), strict=True))
    want = segment.agglomerated(n.astype(float), s, q, 1.0, 0.0)
    number = {k: c for c, k in enumerate(dict.fromkeys(want))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["start"], r["stop"]): r["cluster"] for r in segment.cluster(spark.createDataFrame([(7, *c) for c in cut], "utt long, start long, stop long"), frames).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: number[k] for c, k in zip(sorted(cut), want, strict=True)}
