"""Operators across documents: duplicates, decontamination, chat formatting, the pipeline."""

import hashlib
import itertools
import json
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxlake.llm import bitmap, chat, decontaminate, exact_dedup, quality, simhash
from voxlake.llm.components import components
from voxlake.llm.queries import ORACLES, QUERIES, tokenizer_path

EXTRA = ", block int, flag string, `key` int, row_key string, digest string, again int, score double"
FILL = (1, "f", 2, "r", "d", 3, 0.5)


def table(spark, rows):
    return spark.createDataFrame([(*r, *FILL) for r in rows], f"doc_id long, text string{EXTRA}").repartition(3)


ROWS = [(7, "a  b"), (3, "a\tb"), (5, None), (9, ""), (4, "x" * 50_000), (1, "long " * 20_000), (2, "long\n" * 20_000), (11, "a b"), (11, "a b"), (None, "a b"), (None, "alone"), (20, "z"), (21, " z")]


def test_exact_decisions_equal_brute_force(spark):
    rows = ROWS + [(100 + k, f"copy {k % 3}") for k in range(900)]
    got = sorted((tuple(r) for r in exact_dedup.decisions(table(spark, rows)).collect()), key=str)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.decisions(table(spark, ROWS).limit(0)).count() == 0


def test_exact_deduplicate_keeps_one_of_each(spark):
    docs = table(spark, ROWS)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], len(r["text"] or "")) for r in kept.collect()), key=str) == sorted([(3, 3), (5, 0), (4, 50_000), (1, 100_000), (None, 5), (20, 1), (21, 2)], key=str)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_filter_has_no_false_negatives(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("k"), (F.col("id") % 2000 < 1000).alias("twice"))
    marks = bitmap.build(rows, "k", 2, at_least=2)
    tested = bitmap.test(rows, "k", marks, 2, "out")
    assert tested.where("twice and not out").count() == 0 and tested.where("not twice and out").count() < 100
    assert bitmap.without(rows, "k", rows.where("twice"), "k").count() == 1000


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(own[i] ^ own[i + 1 :]) <= 3):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "a B"), (1006, "w " * 20_000)]
    got = {r["doc_id"]: r for r in simhash.groups(table(spark, rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i]["fp"] % (1 << 64) for i, _ in rows] == prints
    assert [got[i]["component_id"] for i, _ in rows] == brute_components([i for i, _ in rows], prints)
    assert simhash.groups(table(spark, rows).limit(0)).count() == 0


def brute_near(rows):
    """doc_id to the smallest doc_id that links of Jaccard similarity 0.8 reach, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, _), x in zip(rows, sets, strict=True):
        for (j, _), y in zip(rows, sets, strict=True):
            if i < j and len(x & y) * 5 >= len(x | y) * 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("part", [(2048, 1024), (40, 25)])
def test_near_copies_equal_brute_force(spark, part):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (60, 100, 200, 400, 900)]
    for k, text in enumerate(base):
        rows += [(10_000 + 100 * k + j, edited(rng, text, j % 6 if k > 1 else j % 3)) for j in range(60)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "One two"), (20_004, "one  TWO"), (20_005, "two one"), (20_006, "w " * 20_000), (20_007, "W " * 20_001)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, rows), part=part[0], part_docs=part[1]).collect()}
    want = brute_near(rows)
    several = {i for i in want if sum(v == want[i] for v in want.values()) > 1}
    assert got == {i: want[i] for i in several}
    assert len(several) > 250 and want[20_001] == want[20_002] == 20_000 and want[20_004] == 20_003 and want[20_007] == 20_006


def test_recall_of_near_copies_at_the_least_similarity(spark):
    """Pairs of texts with exactly 0.8 of their shingles in common, by the number of shingles."""
    rng = random.Random(11)
    rows, sizes = [], (9, 45, 90, 450)
    for size in sizes:
        for _ in range(300):
            shift = size // 9  # shared: size - shift of size + shift
            words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(size + 4 + shift)]
            rows += [(len(rows), " ".join(words[: size + 4])), (len(rows) + 1, " ".join(words[shift:]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(table(spark, rows)).collect()}
    assert all(c // 2 == d // 2 for d, c in got.items())
    recall = [np.mean([got.get(2 * k + 1) == 2 * k for k in range(300 * i, 300 * i + 300)]) for i in range(len(sizes))]
    assert all(r >= least for r, least in zip(recall, (0.87, 0.94, 0.95, 0.94), strict=True)), recall
    print("recall", dict(zip(sizes, recall, strict=True)))


def test_near_copies_are_dropped_and_clean_documents_stay(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(80)]
    rows = list(enumerate(texts)) + [(100 + k, edited(rng, t, 3)) for k, t in enumerate(texts[:40])] + [(200 + k, edited(rng, t, 60)) for k, t in enumerate(texts[40:])]
    docs = table(spark, [*rows, (None, texts[0]), (5, texts[5])])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*(str(k) for k in range(80)), "5", *(str(200 + k) for k in range(40)), "None"])
    assert simhash.deduplicate(docs.limit(0)).count() == 0 and simhash.near_copies(docs.limit(0)).count() == 0


def test_tiles_are_skipped_by_population_count():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) & rng.choice([0xFF, 0xFFFFFF, (1 << 63) - 1], 3000).astype(np.uint64))
    cell = np.sort(rng.choice([1, 1, 1, 2, 3], len(fp)))
    order = np.lexsort((np.bitwise_count(fp), cell))
    fp = fp[order]
    r, c, compared, skipped = simhash.near_pairs(cell, np.bitwise_count(fp).astype(np.int64), fp[:, None], 3)
    want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero((np.bitwise_count(fp[i] ^ fp) <= 3) & (cell[i] == cell)) if i < j}
    parent = simhash._least(r, c, len(fp))
    assert (parent == simhash._least(*np.array(sorted(want)).T, len(fp))).all()
    assert skipped > 20 and compared > 0


@pytest.mark.parametrize("part", [2048, 60])
def test_dense_groups_lose_no_link(spark, part):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for _ in range(1200):
        x = base[min(int(rng.expovariate(0.5)), 11)]
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    links = simhash.near_links(nodes, part=part)
    assert links.where("a = b").count() == 0
    root = {r["node"]: r["root"] for r in components(links).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    want = brute_components(signed, prints)
    assert [root.get(s, s) for s in signed] == want


@pytest.mark.parametrize("plain", [1_000_000, 0])
def test_components_of_chains_and_stars(spark, plain):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)] + [(1000, 1000), (1005, 1000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long"), plain).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_overlaps(docs, items):
    """Every alignment of every document and item, token by token."""
    split = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    found = set()
    for d, text in docs:
        x = split(text)
        for i, item in items:
            y = split(item)
            if len(y) < decontaminate.SPAN:  # whole, or the whole document
                if y and x == y or len(y) >= decontaminate.WHOLE and any(x[at : at + len(y)] == y for at in range(len(x))):
                    found.add((d, i))
                continue
            w = min(decontaminate.WINDOW, len(y))
            for at in range(-len(y), len(x)):
                same = [0 <= at + q < len(x) and x[at + q] == t for q, t in enumerate(y)]
                if max(sum(same[s : s + w]) for s in range(len(y) - w + 1)) >= -(-w * 3 // 4):
                    found.add((d, i))
    return found


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(6, "one two three"), (7, None), (8, " ".join(word() for _ in range(9)))]
    items += [(10, "four short words here"), (11, " ".join(word() for _ in range(7))), (12, "Yes!"), (13, "... !")]
    items.append((9, items[0][1].upper() + "!"))  # the same tokens: one item
    docs = []
    for k, every in enumerate((0, 3, 4, 5, 6, 7, 8, 9)):
        y = items[k % 6][1].split()
        if every:
            y = [word() if q % every == 1 else t for q, t in enumerate(y)]
        docs.append((k, " ".join(word() for _ in range(15)) + " " + ", ".join(y) + " " + " ".join(word() for _ in range(10))))
    docs += [(20, None), (21, ""), (22, " ".join(word() for _ in range(5000))), (23, docs[0][1]), (23, docs[0][1]), (None, docs[0][1]), (24, "one two three"), (27, "well one two three"), (28, "these are four SHORT words, here"), (29, "four short words there"), (30, f"so {items[10][1]} it is"), (31, "yes"), (32, "yes yes"), (25, items[8][1]), (26, (items[0][1] + " ") * 50)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    own = decontaminate.overlaps(table(spark, docs), items_df)
    got = [(r["doc_id"], r["item_id"]) for r in own.collect()]
    want = brute_overlaps([d for d in docs], [i for i in items if i[0] != 9])
    assert len(got) == len(set(got)) and {g for g in got} == want
    # Every third token substituted leaves 8 of 12 equal, below the share; every fourth leaves 9.
    assert (2, 2) in want and (3, 3) in want and (25, 8) in want and not any(d in (20, 21, 22, 27, 29, 32) for d, _ in got)
    assert {(24, 6), (28, 10), (30, 11), (31, 12)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(table(spark, docs), items_df, most=0).collect()} == want
    left = decontaminate.decontaminate(table(spark, docs), items_df)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({d for d, _ in docs if d is not None} - {d for d, _ in want})
    assert decontaminate.overlaps(table(spark, docs).limit(0), items_df).count() == 0
    assert decontaminate.decontaminate(table(spark, docs), items_df.limit(0)).count() == len(docs)


def test_masks_reach_every_accepted_placement():
    for size in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        for gone in itertools.combinations(range(size), size - -(-size * 3 // 4)):
            assert any(not {at + o for o in m} & set(gone) for m in decontaminate.MASKS for at in range(size - m[-1])), (size, gone)


def test_decontamination_finds_every_placement_of_substitutions(spark):
    docs, items, k = [], [], 0
    for size, most in ((8, 2), (9, 2), (11, 2), (12, 3), (15, 3)):
        item = [f"i{size}x{q}" for q in range(size)]
        items.append((size, " ".join(item)))
        for gone in itertools.combinations(range(size), most):
            y = [f"other{k}" if q in gone else t for q, t in enumerate(item)]
            docs.append((k := k + 1, f"before{k} {' '.join(y)} after{k}"))
    docs += [(9001, "i8x0 i8x1 i8x2 i8x3 i8x4 i8x5"), (9002, "z i15x0 i15x1 i15x2 i15x3 i15x4 i15x5 i15x6 q r i15x9 i15x10 i15x11 i15x12 i15x13 i15x14")]
    got = decontaminate.overlaps(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_overlaps(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {(9001, 8), (9002, 15)} <= want and len(want) == len(docs)


def test_chat_links_orders_and_validates(spark):
    schema = json.dumps({"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False})
    calls = [
        (1, 1, "a", "find", '{"q": "x", "n": 2.0}'), (1, 3, "b", "find", '{"q": {"$ref": "a"}}'), (1, 5, "c", "find", '{"q": {"$ref": "b"}, "n": 0}'), (1, 7, "d", "none", "{}"),
        (2, 1, "x", "find", '{"q": {"$ref": "y"}}'), (2, 2, "y", "find", '{"q": {"$ref": "x"}}'), (2, 3, None, "find", "{broken"), (None, 1, "a", "find", None), (3, 1, "a", "find", '{"q": "é", "z": 1}'), (3, 1, "a", "find", '{"q": "é", "z": 1}'),
    ]
    results = [(1, 2, "a", "first"), (1, 4, "a", "second"), (1, 6, "b", None), (1, 8, "zz", "lost"), (3, 2, "a", "r"), (None, 3, "q", "r"), (2, 9, None, "r")]
    own = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, result string"), {"find": schema})
    rows = own.collect()
    by = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(rows) == 13
    assert [by[1, k]["level"] for k in "abc"] == [0, 1, 2] and by[2, "x"]["level"] == by[2, "y"]["level"] == -1
    assert [by[1, k]["status"] for k in ("a", "b", "c", "zz")] == ["linked", "linked", "pending", "orphan"]
    assert by[1, "a"]["json"] == '{"arguments":{"n":2,"q":"x"},"id":"a","level":0,"name":"find","result":"first","results":2,"status":"linked"}'
    assert by[1, "a"]["valid"] and by[1, "b"]["valid"] and not by[1, "c"]["valid"] and "minimum" in by[1, "c"]["errors"]
    assert by[1, "a"]["results"] == 2 and by[1, "c"]["results"] == 0
    assert by[1, "d"]["errors"] == "unknown tool none" and by[3, "a"]["errors"] == "$.z: not allowed"
    assert sum(r["call_id"] is None for r in rows) == 2 and by[3, "a"]["status"] == "linked"
    empty = own.sparkSession.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string")
    assert chat.link(empty, empty.select("conv_id", "turn", "call_id", F.col("name").alias("result")), {}).count() == 0


def test_chat_takes_hostile_arguments(spark):
    schema = {"type": "object", "properties": {
        "p": {"pattern": "^a"}, "c": {"const": 1}, "e": {"enum": [1, "x"]}, "a": {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "n": {"exclusiveMaximum": 3, "exclusiveMinimum": 0},
        "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer"}}}}
    good = ["{}", '{"p": "ab", "c": 1, "e": "x", "a": 7, "n": 2, "l": [1, 2]}', '{"c": 1.0}', '{"p": {"$ref": "0"}}']
    bad = ["[" * 100_000, "[" * 500 + "]" * 500, '{"p": "ba"}', '{"c": true}', '{"e": true}', '{"a": 4}', '{"n": 3}', '{"n": 0}', '{"l": []}', '{"l": [1, 2, 3]}', '{"l": ["x"]}', '{"$ref": "0"}x', '{"p": {"$ref": "none"}}', "", None, '"\\ud800"']
    calls = [(1, k, str(k), "t", x, "extra") for k, x in enumerate([*good, *bad, '{"z": "\\ud800"}', '{"\\ud83d\\ude00": 1}'])]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, level string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string, json string")
    rows = {int(r["call_id"]): r for r in chat.link(calls, results, {"t": json.dumps(schema)}).collect()}
    assert [rows[k]["valid"] for k in range(len(calls.collect()))] == [True] * len(good) + [False] * len(bad) + [True, True]
    assert all(json.loads(r["json"])["id"] == r["call_id"] for r in rows.values())
    assert rows[len(good)]["errors"] == "arguments are nested too deep" and rows[len(good) + 12]["errors"] == "no call none" and rows[3]["level"] == 1
    assert '"z":"\\ud800"' in rows[len(good) + len(bad)]["json"] and "\U0001f600" in rows[len(good) + len(bad) + 1]["json"]
    for unknown in ({"oneOf": []}, {"properties": {"x": {"format": "date"}}}, {"additionalProperties": {}}, {"type": "date"}):
        with pytest.raises(ValueError):
            chat.link(calls, results, {"t": json.dumps(unknown)})


@pytest.mark.parametrize("group", [1_000, 3])
def test_chat_orders_long_chains_and_cycles(spark, group):
    ref = lambda *ids: json.dumps([{"$ref": str(i)} for i in ids])
    calls = [(1, k, str(k), "t", ref(k - 1) if k else "[]") for k in range(8)] + [(2, 0, "a", "t", ref("b")), (2, 1, "b", "t", ref("a")), (2, 2, "c", "t", ref("b")), (2, 3, "d", "t", "[]"), (2, 4, "e", "t", ref("d", "c")), (2, 5, "f", "t", ref("d")), (2, 6, "g", "t", ref("g"))]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.link(calls, results, {"t": "{}"}, group).collect()}
    assert [got[1, str(k)] for k in range(8)] == list(range(8))
    assert {k: got[2, k] for k in "abcdefg"} == {"a": -1, "b": -1, "c": -1, "d": 0, "e": -1, "f": 1, "g": -1}


def test_chat_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in QUERIES["op8_chat"](spark, sf).collect()]
    own = duckdb.connect()
    own.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = own.sql(ORACLES["op8_chat"])
    assert want.columns == list(chat.COLUMNS) and sorted(rows) == sorted(want.fetchall()) and max(r[4] for r in rows) > 2


def test_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline

    rows = [*ROWS, (30, "<|endoftext|> É\x00"), (31, "\n" * 500)]
    docs = table(spark, rows).withColumn("quality_score", F.lit(9.0)).withColumn("_quality", F.lit("q"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != "encode":
            assert out.columns == docs.columns
            assert out.where("quality_score <> 9 or _quality <> 'q'").count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = [(i, t) for i, t in docs if model.score(np.array([quality.features(t)]))[0] >= 0.5]
    seen = {}
    for i, t in sorted(docs):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    docs = list(seen.values())
    roots = brute_near(docs)
    docs = [(i, t) for i, t in docs if roots[i] == i]
    words = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {i for i, t in docs if any(x in words(t) for x in items)}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == {i for i, _ in docs} - whole
    for i, t in docs:
        if i in rows:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            assert rows[i]["ids"] == ids and rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """All stages in one run over nulls, repeated rows, long texts, clashing columns and no labels at all; and over empty tables."""
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    one, passage = text(60), text(30)
    rows = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, "x" * 50_000), (4, one), (4, one), (5, one.replace(" ", "\n")), (6, f"{one} more"), (7, text(30_000)), (8, f"{text(20)} {passage} {text(9)}"), (9, "short")]
    docs = spark.createDataFrame([(*r, *FILL, "en") for r in rows], f"doc_id long, text string{EXTRA}, source string").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, passage), (3, passage)], "item_id long, text string")
    for name, own in (("documents", docs), ("labels", labels), ("benchmark", items)):
        own.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        own.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, k) for k in (1, 3, 4, 7, 9)] + [(True, 0)]
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_contracted_links_connect_the_same(spark):
    rng = np.random.default_rng(12)
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, 300, (400, 2)) if p[0] != p[1]} | {(int(rng.integers(8)), k) for k in range(1000, 1200) for _ in range(12)}
    links = spark.createDataFrame([*pairs, *list(pairs)[:50]], "a long, b long").repartition(7)
    few = simhash.contracted(links)
    roots = lambda df: {r["node"]: r["root"] for r in components(df).collect()}
    assert roots(few) == roots(links) and few.where("a >= b").count() == 0
    assert few.where("b >= 1000").count() == 200 and few.count() < len(pairs) / 2
    assert simhash.contracted(links.where("false")).count() == 0


def test_repeated_tokens_equal_brute_force(spark):
    """Runs, periods and tables of zeros: seeds that occur at very many places of a document and of an item."""
    rng = random.Random(8)
    parts = ["0 " * 40, "a b " * 25, "x y z " * 15, "0 0 1 " * 12, "one two three four five six seven eight nine ten eleven twelve thirteen", "0 " * 9, "q"]
    noisy = lambda text: " ".join(w if rng.random() > 0.1 else "w" for w in text.split())
    docs = [(k, " ".join(noisy(rng.choice(parts)) for _ in range(rng.randrange(1, 4)))) for k in range(60)]
    items = [(k, t) for k, t in enumerate([*(p.strip() for p in parts), "0 " * 60 + "end", "b a " * 6, "0 0 0 0 0 0 0 0", "0 0 0 0 0", "y z x y z x y z x"])]
    got = decontaminate.overlaps(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()

    def aligned(x, y):
        w = min(decontaminate.WINDOW, len(y))
        if len(y) < decontaminate.SPAN:
            at = [k for k in range(len(x) - len(y) + 1) if x[k : k + len(y)] == y] if len(y) >= decontaminate.WHOLE or x == y else []
            return (len(y), -at[0]) if at else None
        best = None
        for at in range(1 - len(y), len(x)):
            same = [0 <= at + q < len(x) and x[at + q] == t for q, t in enumerate(y)]
            m = max(sum(same[s : s + w]) for s in range(len(y) - w + 1))
            if m >= -(-w * 3 // 4):
                best = max(best or (0, 0), (m, -at))
        return best

    want = {}
    for i, x in docs:
        for j, y in items:
            found = aligned(re.findall(r"[a-z0-9]+", x.lower()), re.findall(r"[a-z0-9]+", y.lower()))
            if found:
                want[i, j] = (found[0], -found[1])
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["at"]) for r in got} == want and len(want) > 100


def test_long_runs_of_one_token_are_quick(spark):
    docs = [(1, "0 " * 20_000), (2, "0 1 " * 10_000)]
    items = spark.createDataFrame([(7, "0 " * 5_000), (8, "1 0 " * 2_500)], "item_id long, text string")
    start = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.overlaps(table(spark, docs), items).collect()}
    assert got == {(1, 7): 12, (2, 8): 12} and time.perf_counter() - start < 60


def test_references_are_parsed(spark):
    schema = json.dumps({"type": "object"})
    ids = ['a"b', "é", "back\\slash", "plain", "\U0001f600"]
    calls = [(1, k, x, "t", "{}") for k, x in enumerate(ids)]
    forms = [
        r'{"x": {"$ref": "a\"b"}}', r'{"x": {"$ref": "\u00e9"}}', r'{"x": [{"$ref": "back\\slash"}]}', r'{"x": {"\u0024ref": "plain"}}', r'{"x": {"$ref": "\ud83d\ude00"}}',
        r'{"x": {"$ref": "plain", "note": 1}}', r'{"$ref": "plain"}', r'{"x": "\"$ref\": \"plain\""}', r'{"x": {"$ref": "gone"}}', r'{"x": {"$ref": "\ud800"}}', "not json $ref",
    ]
    calls += [(1, 10 + k, f"call{k}", "t", f) for k, f in enumerate(forms)]
    own = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string")
    rows = {r["call_id"]: r for r in chat.link(own, results, {"t": schema}).collect()}
    got = [(rows[f"call{k}"]["level"], rows[f"call{k}"]["valid"], rows[f"call{k}"]["errors"]) for k in range(len(forms))]
    assert got[:5] == [(1, True, "")] * 5 and got[5:8] == [(0, True, "")] * 3
    assert got[8] == (0, False, "no call gone") and not got[9][1] and got[9][2].startswith("no call") and got[10] == (0, False, "arguments are not JSON")
