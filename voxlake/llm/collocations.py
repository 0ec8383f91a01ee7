"""Phrases whose words occur together more than their parts would have it, by suffix automata of bounded depth.

A shard is up to two million words of one language. Its generalised suffix automaton, cut off at the longest phrase, is
built in bulk: the words before each place are one number, and a sort of these numbers lays out the tree of suffix
links. A state is a class of phrases with the same end positions in the shard, so it has one count for all its lengths.

Counts meet twice. First the shards send eight bytes of hash and a small count for each phrase, packed by ranges of
hashes; phrases whose hash reaches the least count pass a bitmap. Then the shards send the phrases themselves that pass,
and their exact counts are summed. A hash that two phrases share can only let one more through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, with_group, written

#: Most words of a phrase. Words of a shard, so that three of its word numbers fit 63 bits.
DEPTH, SHARD = 3, 2_000_000
#: Bits of one word number in a key.
BITS = 21
#: Bytes of one language's texts that a task holds before it closes a shard; of all languages, four times as many.
HELD = 12_000_000
#: Bytes of texts that are split into words at a time.
SPLIT = 1_000_000
#: Hashes that one group of the first sum is meant to hold, and the most bits of the filter (64 MB).
PART, MOST_BITS = 4_000_000, 29

#: Bytes: 0 belongs to a word, 1 ends a word, 2 ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Phrases of one batch that is sent.
SENT = 20_000

MIXES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(texts: list[bytes]) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The words of some texts in a row, and for each whether it is the first of its piece; A-Z become lower case. Takes the texts away."""
    chunks, firsts, own, size = [], [], [], 0
    texts.reverse()
    while texts:
        own.append(texts.pop())
        size += len(own[-1]) + 1
        if size >= SPLIT or not texts:
            words, first = _split(own)
            chunks.append(words)
            firsts.append(first)
            own, size = [], 0
    return pa.chunked_array(chunks, pa.large_binary()), np.concatenate(firsts) if firsts else np.zeros(0, bool)


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.searchsorted(np.flatnonzero(kind == 2), starts)
    first = np.diff(breaks, prepend=-1) != 0
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, first


class Automaton:
    """The states of a shard's suffix automaton up to DEPTH words.

    For each depth d: `nodes[d]` holds the keys of the phrases of d words (the last word in the highest bits), `counts[d]`
    their numbers of end positions, and `links[d]` where in depth d - 1 the phrase without its first word is: its suffix link,
    or a shorter phrase of the same state where the counts are equal. `state(d)` tells which phrases are the longest of theirs.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, words: int, skip: int = 0):
        """`codes` number the words from 0 to words - 1; the first `skip` places are only context."""
        if words >= 1 << BITS:
            raise ValueError("too many words for one shard")
        # A shard's places and counts fit 32 bits; only keys need 64.
        at = np.arange(len(codes), dtype=np.int32)
        inside = at - np.maximum.accumulate(np.where(first, at, np.int32(0)))  # words of the piece before each one
        keys = codes.astype(np.int64) + 1
        keys <<= BITS * (DEPTH - 1)
        for d in range(1, DEPTH):
            before = np.where(inside[d:] >= d, codes[:-d] + 1, 0).astype(np.int64)
            before <<= BITS * (DEPTH - 1 - d)
            keys[d:] |= before
        del at, inside, before
        keys = keys[skip:]
        keys.sort()
        self.nodes, self.counts, self.links = {}, {}, {}
        above = np.zeros(len(keys), np.int32)
        for d in range(1, DEPTH + 1):
            cut = keys >> (BITS * (DEPTH - d)) if d < DEPTH else keys
            new = np.flatnonzero(np.append(cut[:1] != -1, cut[1:] != cut[:-1])).astype(np.int32)
            size = np.diff(new, append=np.int32(len(cut)))
            node = cut[new]
            real = (node & ((1 << BITS) - 1)) != 0  # no place before the piece's start
            self.nodes[d], self.counts[d], self.links[d] = node[real], size[real], above[new[real]]
            if d < DEPTH:
                number = np.zeros(len(new), np.int32)
                number[real] = np.arange(real.sum(), dtype=np.int32)
                above = np.repeat(number, size)

    def word(self, d: int, k: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The numbers of the k-th words (from 0) of phrases of d words: of all, or of those chosen."""
        return ((self.nodes[d][which] >> (BITS * k)).astype(np.int32) & ((1 << BITS) - 1)) - 1

    def words(self, d: int) -> list[np.ndarray]:
        """The word numbers of the phrases of d words, in the order of reading."""
        return [self.word(d, k) for k in range(d)]

    def longest(self, d: int) -> np.ndarray:
        """Whether a phrase of d words is the longest of its state: no longer one ends at all the same places."""
        out = np.ones(len(self.nodes[d]), bool)
        if d < DEPTH:
            link = self.links[d + 1]
            out[link[self.counts[d + 1] == self.counts[d][link]]] = False
        return out


def hashes(automaton: Automaton, names: np.ndarray, d: int) -> np.ndarray:
    """A hash for each phrase of d words, by those of its words."""
    h = np.full(len(automaton.nodes[d]), d, np.uint64)
    for k in range(d):
        h ^= names[automaton.word(d, k)]
        h *= MIXES[0]
        h ^= h >> np.uint64(29)
        h *= MIXES[1]
        h ^= h >> np.uint64(32)
    return h


def _built(words: pa.ChunkedArray, first: np.ndarray, start: int) -> tuple[pa.Array, Automaton]:
    """Words and automaton of the shard that starts at a word."""
    context = min(start, DEPTH - 1)
    own = words.slice(start - context, context + SHARD).combine_chunks().dictionary_encode()
    flags = first[start - context : start + SHARD].copy()
    flags[:1] = True
    return own.dictionary, Automaton(own.indices.to_numpy(), flags, len(own.dictionary), context)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Automaton]]:
    """(lang, words, automaton) of batches of (lang, text); a text longer than a shard is several, with the words before as context."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> Iterator[tuple[str, pa.Array, Automaton]]:
        del sizes[lang]
        words, first = words_of(held.pop(lang))
        for start in range(0, max(len(words), 1), SHARD):
            yield lang, *_built(words, first, start)

    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text.encode())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
            if sizes[lang] >= HELD:
                yield from close(lang)
        while sum(sizes.values()) >= 4 * HELD:
            yield from close(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from close(lang)


def named(lang: str, words: pa.Array) -> np.ndarray:
    """A hash of each word of a language."""
    seed = xxhash.xxh3_64_intdigest(lang)
    own = xxhash.xxh3_64_intdigest
    return np.fromiter((own(w, seed) for start in range(0, len(words), 10_000) for w in words.slice(start, 10_000).to_pylist()), np.uint64, len(words))


def _sent(batches: Iterator[pa.RecordBatch], bits: int, enough: int) -> Iterator[pa.RecordBatch]:
    """(part, hashes, counts): each shard's hashes, packed by their highest bits. A count above `enough` is sent as that."""
    for lang, words, automaton in shards(batches):
        names = named(lang, words)
        for d in range(1, DEPTH + 1):
            if len(automaton.nodes[d]):
                yield _by_part(hashes(automaton, names, d), automaton.counts[d], bits, min(enough, 255))
        del words, automaton, names  # or they would stay while the next shard is built


def _by_part(h: np.ndarray, counts: np.ndarray, bits: int, top: int) -> pa.RecordBatch:
    order = np.argsort(h)
    h, n = h[order], np.minimum(counts, top).astype(np.uint8)[order]
    del order
    part = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(starts, len(h)).astype(np.int32)
    packed = lambda values, width: pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), packed(h, 8), packed(n, 1)], names=["part", "hashes", "counts"])


def _frequent(group: pa.Table, enough: int) -> pa.Table:
    """(part, n, hashes): the hashes of one part that occur often enough, summed over shards."""
    h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("counts")])
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
    own = h[starts][np.add.reduceat(n, starts) >= min(enough, 255)]
    return pa.table({"part": group.column("part")[:1], "n": pa.array([len(own)], pa.int64()), "hashes": pa.array([own.tobytes()], pa.binary())})


def _marks(batches: Iterator[pa.RecordBatch], part_bits: int, piece_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(piece, marked): the piece of the bitmap that the hashes of each part mark."""
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            piece, size = part >> (part_bits - piece_bits), 1 << (bits - piece_bits)
            own = np.zeros(size, np.uint8)
            own[(np.frombuffer(packed, np.uint64) >> np.uint64(64 - bits)).astype(np.int64) - piece * size] = 1
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "marked": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})


def _passing(batches: Iterator[pa.RecordBatch], marks, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n) of the phrases of each shard whose hash is marked."""
    marked = np.frombuffer(marks.value, np.uint8)
    for lang, words, automaton in shards(batches):
        names, text = named(lang, words), words.cast(pa.large_string())
        total = int(automaton.counts[1].sum())
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "size": pa.array([0], pa.int32()), "phrase": pa.array([""], pa.string()), "n": pa.array([total], pa.int64())})
        for d in range(1, DEPTH + 1):
            at = hashes(automaton, names, d)
            at >>= np.uint64(64 - bits)
            keep = np.flatnonzero((marked[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(np.int32)
            del at
            for start in range(0, len(keep), SENT):
                own = keep[start : start + SENT]
                parts = [text.take(pa.array(automaton.word(d, k, own))) for k in range(d)]
                phrase = parts[0] if d == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(own), pa.string()), "size": pa.array(np.full(len(own), d, np.int32)), "phrase": phrase.cast(pa.string()), "n": pa.array(automaton.counts[d][own].astype(np.int64))}
                )
        del words, automaton, names, text  # or they would stay while the next shard is built


def phrase_counts(docs: DataFrame, enough: int = 10) -> DataFrame:
    """(lang, size, phrase, n): every word and phrase of up to DEPTH words that occurs `enough` times in its language, counted over all documents.

    Words are joined by one space; the row of size 0 counts all words of the language. Null texts are empty, a null lang
    is `und`; overlapping occurrences count.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    letters = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # A phrase for each length ends at each word, and words and their gap have some five bytes at least in the mean.
    part_bits = max(3, (max(letters, 1) * DEPTH // 6 // PART).bit_length())
    sent = own.mapInArrow(partial(_sent, bits=part_bits, enough=enough), "part long, hashes binary, counts binary")
    often = written(sent.groupBy("part").applyInArrow(lambda group: _frequent(group, enough), "part long, n long, hashes binary"))
    kept = often.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(part_bits + 3, (kept * 16).bit_length()))
    piece_bits = min(part_bits, bits - 3)
    pieces = often.mapInArrow(partial(_marks, part_bits=part_bits, piece_bits=piece_bits, bits=bits), "piece long, marked binary")
    marks = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - 3 - piece_bits)
    for r in pieces.collect():  # 64 MB in all at most, whatever the corpus
        marks[r["piece"] * size : (r["piece"] + 1) * size] |= np.frombuffer(r["marked"], np.uint8)
    shared = spark.sparkContext.broadcast(marks.tobytes())
    found = own.mapInArrow(partial(_passing, marks=shared, bits=bits), "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= enough) | (F.col("size") == 0))


def collocations(docs: DataFrame, enough: int = 10, share: int = 50, top: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two or three words of each language that score best.

    `docs` has lang and text; see `phrase_counts`. a, l and r count the phrase, its first part and the rest, for the
    cut with the lowest score floor(1000000 a a / (l r)), of equal ones the first; n counts the language's words. A
    phrase of two words is left out if one of three has it and at least `share` hundredths of its count. Ranked by
    score, count and phrase (in byte order). An empty table gives no rows.
    """
    counts = written(phrase_counts(docs, enough).withColumn("key", F.concat("lang", F.lit("\t"), "phrase")))
    words = F.split("phrase", " ")
    long = counts.where("size > 1").select("lang", "size", "phrase", "key", F.col("n").alias("a"), words.alias("w"))

    # The suffix link of a phrase of three words is the last two; its first two are where it came from.
    inner = F.explode(F.array(F.concat_ws(" ", F.slice("w", 2, 2)), F.concat_ws(" ", F.slice("w", 1, 2))))
    over = long.where("size = 3").select("lang", inner.alias("inner"), "a")
    over = over.groupBy(F.concat("lang", F.lit("\t"), "inner").alias("key")).agg(F.max("a").alias("over"))
    stays = long.join(over, "key", "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * share)).drop("over")

    # Each cut's two parts, with their counts.
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.concat_ws(" ", F.slice("w", 1, k)).alias("head"), F.concat_ws(" ", F.slice("w", F.lit(k + 1), F.size("w"))).alias("rest"))
    cuts = stays.select("lang", "phrase", "a", F.explode(F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("cut"))
    part = lambda side, name: F.struct(F.lit(side).alias("side"), F.concat("lang", F.lit("\t"), F.col(f"cut.{name}")).alias("key"))
    sides = cuts.select("lang", "phrase", "a", "cut.k", F.explode(F.array(part(0, "head"), part(1, "rest"))).alias("part"))
    sides = written(sides.select("lang", "phrase", "a", "k", "part.side", "part.key"))
    # Parts of very many phrases are few, so they are broadcast; the others are joined by key.
    used = sides.groupBy("key").agg(F.count(F.lit(1)).alias("used"))
    parts = written(used.join(counts.select("key", "n"), "key"))
    met = with_group(sides, parts, "key", "used", sides.count())
    both = met.groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r")
    )
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = both.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")).withColumn("below", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole = counts.where("size = 0").select("lang", F.col("n").alias("words"))
    return best.join(whole, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
