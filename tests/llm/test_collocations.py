"""Phrase mining against plain counting."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxlake.llm import collocations as own
from voxlake.llm.queries import ORACLES, op13_collocations

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(rows, enough=10, share=50, top=2000):
    counts, totals = {}, {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, {})
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang if lang is not None else "und"] = totals.get(lang if lang is not None else "und", 0) + len(words)
            for d in (1, 2, 3):
                for k in range(len(words) - d + 1):
                    f[tuple(words[k : k + d])] = f.get(tuple(words[k : k + d]), 0) + 1
    out = []
    for lang, f in counts.items():
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= enough}
        found = []
        for p, a in c.items():
            if any(len(t) > len(p) and p in (t[:2], t[1:]) and 100 * n >= share * a for t, n in c.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "of", "été", "x", "\x00", "new york", "new", "york", "city", "a", "b", "ab", "1", "'s", "Ab"]
    gaps = [" ", "  ", "\t", " \t", ". ", ", ", "\n", "!?", " ", " ", " "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "fr", None, "und", "", "e\tn"]), text if rng.random() > 0.02 else None))
    return rows + [("en", "rare pair " * 12), ("en", " lead"), ("fr", "..."), ("en", "New York City " * 9), ("long", "one two three four five six " * 4_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, *r, "k", 1, "p", 2) for k, r in enumerate(rows)], "doc_id long, lang string, text string, key string, n int, phrase string, size int").repartition(5)
    got = found(own.collocations(docs))
    assert got == brute(rows) and {x[0] for x in got} >= {"en", "fr", "und", "long"}
    assert found(own.collocations(docs, enough=3, share=90, top=7)) == brute(rows, 3, 90, 7)
    assert own.collocations(docs.limit(0)).count() == 0
    assert own.collocations(docs.where("text is null")).count() == 0


def test_shards_cut_anywhere(monkeypatch):
    """Small shards count as one large one: words before a cut are context."""
    rows = corpus(3) + corpus(4)
    batch = pa.record_batch({"lang": ["x"] * len(rows), "text": [t or "" for _, t in rows]})

    def counted():
        out = {}
        for _, words, automaton in own.shards([batch]):
            w = words.to_pylist()
            for d in (1, 2, 3):
                for codes, n in zip(zip(*automaton.words(d), strict=True), automaton.counts[d].tolist(), strict=True):
                    p = b" ".join(w[c] for c in codes)
                    out[p] = out.get(p, 0) + n
        return out

    whole = counted()
    monkeypatch.setattr(own, "SHARD", 7)
    monkeypatch.setattr(own, "HELD", 1_000)
    assert counted() == whole and len(whole) > 1_000


@pytest.mark.parametrize("step", ["sent", "passing"])
def test_a_task_holds_one_shard(monkeypatch, step):
    """The arrays of a task stay within a few times the text of one shard, however many shards follow."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 2_000) % 30_000) for _ in range(600)]
    monkeypatch.setattr(own, "HELD", 2_000_000)
    marks = type("Marks", (), {"value": b"\xff" * 8})
    batches = [pa.record_batch({"lang": ["x"] * 100, "text": texts[k : k + 100]}) for k in range(0, 600, 100)]
    run = own._sent(iter(batches), 3, 10) if step == "sent" else own._passing(iter(batches), marks, 6)
    tracemalloc.start()
    try:
        assert sum(1 for _ in run) > 2
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 2 * own.HELD and peak < 22 * own.HELD, f"{peak / own.HELD:.1f}"


def test_states_are_classes_of_end_positions():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 60)
    first = rng.random(60) < 0.2
    first[0] = True
    automaton = own.Automaton(codes, first, 4)
    ends = {}
    for at in range(60):
        for d in (1, 2, 3):
            if at - d + 1 >= 0 and not first[at - d + 2 : at + 1].any():
                ends.setdefault(tuple(codes[at - d + 1 : at + 1]), set()).add(at)
    for d in (1, 2, 3):
        phrases = list(zip(*(c.tolist() for c in automaton.words(d)), strict=True))
        assert sorted(phrases) == sorted(p for p in ends if len(p) == d)
        longest = automaton.longest(d)
        for k, p in enumerate(phrases):
            assert automaton.counts[d][k] == len(ends[p])
            if d > 1:
                above = list(zip(*(c.tolist() for c in automaton.words(d - 1)), strict=True))
                assert above[automaton.links[d][k]] == p[1:]
            assert longest[k] == (not any(len(q) > d and q[-d:] == p and e == ends[p] for q, e in ends.items()))


def test_filter_of_any_size(spark, monkeypatch):
    """More parts than the bitmap has pieces, and a bitmap so small that it lets nearly all through, change nothing."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(own, "MOST_BITS", 6)
    monkeypatch.setattr(own, "PART", 100)
    assert found(own.collocations(docs)) == brute(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = base.sql(ORACLES["op13_collocations"])
    got = op13_collocations(spark, sf)
    assert want.columns == got.columns and sorted(want.fetchall()) == found(got)
