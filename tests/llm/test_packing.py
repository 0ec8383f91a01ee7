"""Packing: token ids of the library, whole sequences without gaps, bounds that hold."""

import itertools
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxlake.llm import packing
from voxlake.llm.queries import op11_best_fit_packing, tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "word " * 30_000, "x" * 50_000, "same text", "same text", "É à ß　İ\x00\x1c\U0001f600 <|endoftext|> it's 12", "\n\n\t", "<|endoftext|><|endof", "tail  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    own.no_padding()
    own.no_truncation()
    return own


def checked(rows, library, texts, capacity):
    """The rows of one packing hold every text's ids once, in sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for key, own in by_doc.items():
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(own, key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:]) and 1 <= own[0]["length"] <= capacity
        for r, start in zip(own, itertools.accumulate([r["length"] for r in own], initial=0), strict=False):
            assert r["start"] == start and r["ids_crc32"] == zlib.crc32(ids[start : start + r["length"]].tobytes())
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_encoder_equals_library(library):
    own = packing.encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    pools = [[chr(i) for i in range(0x250)], list("etaoin shrdlu'"), ["<|endoftext|>", "<|", "ing", " ", "É", "'re", "1", "\n"], [chr(i) for i in (*range(0x300, 0x310), *range(0x1F600, 0x1F610), *range(0x3A0, 0x3D0), 0x2028, 0x200D, 0xA0)]]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randrange(30)))
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_assigned_code_point_is_encoded_as_the_library_does(library):
    own = packing.encoding(RANKS, public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    for start in range(0, len(points), 64):
        text = " ".join(f"a{c}b{c}1{c}" for c in points[start : start + 64])
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids, start


def least_bins(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                place(k + 1, bins)
                bins[i] -= sizes[k]
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_bounds_hold_and_best_fit_packs():
    rng = random.Random(2)
    certified = 0
    for _ in range(400):
        capacity = rng.choice([7, 10, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        bins, offsets, room = packing.best_fit(np.array(sizes), capacity)
        bound, least = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity), least_bins(sizes, capacity)
        assert bound <= least <= len(room) and bound >= -(-sum(sizes) // capacity)
        assert all((capacity - room)[k] == sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(len(room)))
        certified += bound == len(room)
    assert certified > 300
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3  # more than the sum of lengths says
    assert packing.lower_bound(np.bincount([4] * 5, minlength=11), 10) == 3


def test_odd_texts(spark, library):
    rows = [(k, t, "p", 1, "o", 2.0, 3) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, start int, offset string, length double, settled int").repartition(3)
    texts = dict(enumerate(ODD))
    for capacity in (16, 2048):
        cut = packing.pieces(docs, RANKS, public_tokenizers.PATTERN, capacity=capacity, keep_ids=True)
        packed = packing.pack(cut.withColumn("settled", F.lit("own")).withColumn("certified", F.lit(3)), capacity=capacity, group=200)
        got = packed.collect()
        assert {r["settled"] for r in got} == {"own"}
        assert checked(got, library, texts, capacity) <= packing.least(cut, capacity=capacity) * 1.1 + 1
        for r in packing.sequences(packed).collect():
            own = sorted((x for x in got if x["sequence_id"] == r["sequence_id"]), key=lambda x: x["offset"])
            assert r["ids"] == [i for x in own for i in x["ids"]]
    assert packing.pack(packing.pieces(docs.limit(0), RANKS, public_tokenizers.PATTERN)).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 5 + [(None, "a b")], "doc_id long, text string")
    packed = packing.pack(packing.pieces(same, RANKS, public_tokenizers.PATTERN))
    assert sorted(r["offset"] for r in packed.collect()) == [0, 3, 6, 9, 12, 15] and packed.select("sequence_id").distinct().count() == 1


def test_rounds_bring_partitions_to_the_bound(spark):
    """Many small partitions: their emptiest sequences and their gaps are packed anew, and no row is lost."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1500)) + 1).alias("length"))
    packed = packing.pack(rows, group=1_000)
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("rows"), F.countDistinct("offset").alias("places"))
    total = used.agg(F.count("*").alias("k"), F.max("n").alias("top"), F.sum("rows").alias("rows"), F.sum("places").alias("places")).first()
    assert (total["rows"], total["places"]) == (20_000, 20_000) and total["top"] <= 2048
    assert total["k"] <= packing.least(rows) * 1.0015 < packing.pack(rows, group=1_000, rounds=1).select("sequence_id").distinct().count()
    hard = spark.range(3_000).select((F.lit(700) + F.col("id") % 7).alias("length"))  # no bound meets what best fit needs of these
    packed = packing.pack(hard, group=500)
    assert packed.count() == 3_000 and packed.select("sequence_id").distinct().count() == 1_500


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = op11_best_fit_packing(spark, sf)
    types = dict(found.dtypes)
    assert types["piece"] == "int" and all(types[c] == "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"))
    assert checked(found.collect(), library, texts, 2048) <= packing.least(found) + 1
