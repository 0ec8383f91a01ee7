"""The prefix trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from voxlake.llm import trie
from voxlake.llm.queries import ORACLES, op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, seq int, id int, depth string, n int, ends int, size int, parts int"
FILL = ("k", 1, 2, "d", 3, 4, 5, 6)


def brute_sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(x)] for c, x in own.items()}


def brute_rebuilt(own):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def brute_nodes(own):
    members, ends = {}, {}
    for c, seq in own.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda c: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()
    )


def found(df):
    assert df.columns == list(trie.COLUMNS) and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *FILL) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40), (4, 40)])
def test_nodes_equal_brute_force(spark, seed, parts):
    """Few words make deep shared paths; more ranges than sequences cut them everywhere, through copies, prefixes and unary nodes."""
    rng = random.Random(seed)
    texts = ["", "a", "bb", "é" * 3, None] if seed % 2 else ["x", "yy"]
    stems = [[rng.choice(texts) for _ in range(rng.randrange(12))] for _ in range(4)]
    rows = []
    for c in range(150):
        seq = rng.choice(stems)[: rng.randrange(13)] + [rng.choice(texts) for _ in range(rng.randrange(1, 4))]
        rows += [(c * rng.choice([1, 1, 1000]) + (100_000 if c % 3 else 0), k, "user", t) for k, t in enumerate(seq)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = brute_sequences(rows)
        sequences = trie.sequences(table(spark, rows))
        assert found(trie.nodes(sequences)) == brute_nodes(own)
        c = F.col("conv_id")
        mixed = trie.rebuilt(sequences, c - c % 5, F.crc32(c.cast("string")) % 9, 8)
        assert found(trie.nodes(mixed)) == brute_nodes(brute_rebuilt(own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "of nobody"), (1, None, None, None), (1, 0, "user", "x" * 100_000), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (2, 0, "user", "a"),
        (2, 0, "user", "a"), (3, 5, "user", ""), (-4, 1, "a", "b"), (-5, 1, "ab", ""), (10**15, 1, "a", "b"),
    ]
    rows += [(7, k, "user", "again") for k in range(600)]  # a long conversation
    got = trie.nodes(trie.sequences(table(spark, rows)))
    assert found(got) == brute_nodes(brute_sequences(rows))
    last = trie.last_turns(got, table(spark, rows)).where("conv_id = 1 and depth = 2").collect()
    assert [(r["role"], r["text"]) for r in last] == [("assistant", "b")]
    assert trie.nodes(trie.sequences(table(spark, rows).limit(0))).count() == 0


def test_members_over_many_ranges_of_ids(spark):
    """A sequence that very many conversations have: its ids come in order from rows of 4,096 at most."""
    own = spark.range(-5_000, 25_000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    want = brute_nodes({c: [(b"user", b"hot" if c % 3 == 0 else f"t{c}".encode())] for c in range(-5_000, 25_000)})
    assert found(trie.nodes(trie.sequences(own))) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_prefix_trie(spark, sf)) == brute_nodes(brute_rebuilt(brute_sequences(rows)))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    sql = base.sql(ORACLES["op12_prefix_trie"])
    assert sql.columns == list(trie.COLUMNS)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in sql.fetchall()) == brute_nodes(brute_rebuilt(brute_sequences(rows)))
