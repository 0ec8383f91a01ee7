"""Cross-entropy difference of two n-gram models that share one vocabulary.

The target model counts the documents that labels mark as wanted, the background model all documents. Both
are interpolated bigram models over the same words, each smoothed by the same share of its own mass, so a
score doesn't depend on how much larger the background is. A document's score is its mean loss per token
under the target less that under the background: the lower, the more it is like the target.

Words and bigrams are 64-bit hashes, even ones of words and odd ones of bigrams. Documents are packed in
chunks of bounded text and written once. A chunk sends each of its distinct hashes with its own counts to
the part that sums that hash over the corpus, and gets the sums back in the same order. So a frequent bigram
costs a row for each chunk, not for each document, and no task holds more than a chunk's text or a part's
hashes, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced, written

#: Bytes of text in a chunk, and hashes that a part sums.
CHUNK, PART = 8_000_000, 2_000_000
#: Weight of the bigram estimate, and the share of a word's estimate that is spread over all words.
MIX, SPREAD = 0.6, 0.1

BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
CODEC = "zstd"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(BREAKS).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & EVEN


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of bigrams."""
    z = before * ODD[0]
    z ^= z >> np.uint64(29)
    z = (z + word) * ODD[1]
    return (z ^ (z >> np.uint64(32))) | np.uint64(1)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, how many each text has, and the places of words that have one before them in their text."""
    own = [_hashes(words_of(t or "")) for t in texts]
    size = np.array([len(h) for h in own], np.int64)
    inner = np.ones(size.sum(), bool)
    inner[(np.cumsum(size) - size)[size > 0]] = False
    return np.concatenate([*own, np.zeros(0, np.uint64)]), size, np.flatnonzero(inner)


@dataclass(frozen=True)
class Models:
    """The documents that the models count, and the same packed in chunks, with a mark on those that the target counts."""

    source: DataFrame
    packed: DataFrame
    text: str


@dataclass(frozen=True)
class Totals:
    """What is known of all documents: the tokens of the background and of the target, and the number of words."""

    mass: tuple[int, int]
    size: int

    def losses(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Loss in nats of tokens by the counts of the word, the word before and both, each (2, n): background, target. Without a word before, or if the model lacks it, the word's own estimate counts."""
        mass = np.array(self.mass, float)[:, None]
        if not self.mass[1]:  # without a target both models are the same
            word, before, pair, mass = word[[0, 0]], before[[0, 0]], pair[[0, 0]], mass[[0, 0]]
        one = (1 - SPREAD) * word / np.maximum(mass, 1) + SPREAD / max(self.size, 1)
        two = pair / np.maximum(before, 1)
        return -np.log(np.where(before > 0, MIX * two + (1 - MIX) * one, one))


def _pack(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows in chunks of so much text, as compressed Arrow streams."""
    held, size, n = [], 0, 0

    def flush() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as out:
            for x in held:
                out.write_batch(x)
        number = (TaskContext.get().partitionId() << 32) + n
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bytes", "blob"])

    for batch in sliced(batches, 256):
        if not batch.num_rows:
            continue
        held.append(batch)
        size += sum(len(t) for t in batch.column("held").to_pylist() if t)
        if size >= chunk:
            yield flush()
            held, size, n = [], 0, n + 1
    if held:
        yield flush()


def _rows(blob: bytes) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(blob))


def _chunks(docs: DataFrame, columns: list[str], text: str, wanted: Column, chunk: int) -> DataFrame:
    """(chunk, bytes, blob): the rows in chunks of bounded text, written to the shared folder; their columns are numbered, as names may clash."""
    own = docs.select(wanted.alias("wanted"), F.col(text).cast("string").alias("held"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns) if c != text))
    return written(own.mapInArrow(partial(_pack, chunk=chunk), "chunk long, bytes long, blob binary"))


def train(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> Models:
    """Models of all documents: as background every one, as target those whose id is in `wanted` (doc_id).

    Documents are packed here; their words and bigrams are summed when documents are scored, as only the sums
    of those that occur in them are needed. Without a target document the two models are the same, and every
    score is 0. Null texts are empty, null ids are not wanted.
    """
    own, flag = fresh(docs.columns, "own", "wanted")
    ids = wanted.select(F.col("doc_id").cast("long").alias(own)).where(F.col(own).isNotNull()).distinct().withColumn(flag, F.lit(True))
    keyed = docs.withColumn(own, F.col(doc_id).cast("long"))
    if ids.count() <= 1_000_000:
        joined = keyed.join(F.broadcast(ids), own, "left")
    else:  # rows without an id stay where they are
        joined = keyed.where(F.col(own).isNotNull()).join(ids, own, "left").unionByName(keyed.where(F.col(own).isNull()).withColumn(flag, F.lit(None).cast("boolean")))
    return Models(docs, _chunks(joined, docs.columns, text, F.coalesce(flag, F.lit(False)), chunk), text)


def _packed(*columns: np.ndarray) -> bytes:
    """Numbers of columns of one length, byte by byte, compressed."""
    raw = b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=CODEC, asbytes=True), np.uint8)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw.reshape(columns, 8, -1)]


def _ask(batches: Iterator[pa.RecordBatch], parts: int, replies: bool, counts: bool) -> Iterator[pa.RecordBatch]:
    """Messages of each chunk to the parts: its distinct hashes in order, as differences, with its own counts."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held, wanted = [], []
            for rows in _rows(blob):
                h, size, inner = _tokens(rows.column("held").to_pylist())
                marked = np.repeat(rows.column("wanted").to_numpy(zero_copy_only=False), size)
                held += [h, _pairs(h[inner - 1], h[inner])]
                wanted += [marked, marked[inner]]
            all_of = np.concatenate(held)
            code, background = np.unique(all_of, return_counts=True)
            target = np.zeros_like(background)
            some, n = np.unique(all_of[np.concatenate(wanted)], return_counts=True)
            target[np.searchsorted(code, some)] = n
            if not counts:
                background[:] = target[:] = 0
            cuts = [0, *np.searchsorted(code, edges).tolist(), len(code)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    blob = _packed(np.diff(code[a:b], prepend=np.uint64(0)), background[a:b], target[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([chunk if replies else -1], pa.int64()), pa.array([blob], pa.binary())], names=["part", "chunk", "blob"])


ANSWERS = ("chunk", "part", "blob", "size", "background", "target")


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of parts: to each message the sums of its hashes over all messages, in its order; and a row with the part's totals. Rows arrive in order of part."""

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if n == "blob" else pa.int64()) for n, v in zip(ANSWERS, values, strict=True)], names=list(ANSWERS))

    def answers(part: int, chunks: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [_unpacked(b, 3) for b in blobs]
        code = np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found])
        order = np.argsort(code, kind="stable")  # merges the messages, which are sorted
        code = code[order]
        new = np.append(True, code[1:] != code[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        words = code[new] & np.uint64(1) == 0
        sums = [np.bincount(of, np.concatenate([f[k] for f in found])).astype(np.int64) for k in (1, 2)]
        counted = words & (sums[0] > 0)
        yield row(-1, part, None, int(counted.sum()), *(int(s[words].sum()) for s in sums))
        at = 0
        for chunk, (own, *_) in zip(chunks, found, strict=True):
            here = of[at : at + len(own)]
            at += len(own)
            if chunk >= 0:
                yield row(chunk, part, _packed(sums[0][here], sums[1][here]), 0, 0, 0)

    part, chunks, blobs = None, [], []
    for batch in batches:
        for p, c, blob in zip(*(batch.column(x).to_pylist() for x in ("part", "chunk", "blob")), strict=True):
            if p != part and blobs:
                yield from answers(part, chunks, blobs)
                chunks, blobs = [], []
            part = p
            chunks.append(c)
            blobs.append(blob)
    if blobs:
        yield from answers(part, chunks, blobs)


def _losses(texts: list[str | None], sums: list[np.ndarray], totals: Totals) -> list[np.ndarray]:
    """Numbers of words and both models' mean losses of a chunk's texts, by the sums of its hashes in order."""
    h, size, inner = _tokens(texts)
    _, of = np.unique(np.concatenate([h, _pairs(h[inner - 1], h[inner])]), return_inverse=True)
    found = np.stack([np.concatenate([s[k] for s in sums] or [np.zeros(0)]).astype(float) for k in (0, 1)])
    word = found[:, of[: len(h)]]
    before, pair = np.zeros_like(word), np.zeros_like(word)
    before[:, inner], pair[:, inner] = word[:, inner - 1], found[:, of[len(h) :]]
    at = np.repeat(np.arange(len(size)), size)
    background, target = (np.bincount(at, x, len(size)) / np.maximum(size, 1) for x in totals.losses(word, before, pair))
    return [size, target, background, target - background]


def _answered(batches: Iterator[pa.RecordBatch], totals: Totals, sources: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Documents with their losses. Rows arrive in order of chunk, its answers in order of part before its documents."""
    chunk, sums = None, []
    for batch in batches:
        for c, kind, blob in zip(*(batch.column(x).to_pylist() for x in ("chunk", "kind", "blob")), strict=True):
            if c != chunk:
                chunk, sums = c, []
            if not kind:
                sums.append(_unpacked(blob, 2))
                continue
            rows = pa.Table.from_batches(_rows(blob)).combine_chunks()
            own = {n: rows.column(source) for n, source in sources.items()}
            own |= dict(zip(ADDED, map(pa.array, _losses(rows.column("held").to_pylist(), sums, totals)), strict=True))
            yield from pa.Table.from_pydict(own).to_batches(max_chunksize=4096)


ADDED = ("n_words", "target_loss", "background_loss", "difference")


def score(docs: DataFrame, models: Models, text: str = "text", chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """`docs` with n_words, target_loss, background_loss and difference (target less background) of each whole text.

    A null or empty text has no tokens and 0 everywhere. Equal texts score alike. Columns with these names are
    replaced; all others pass through, the text as a string. Documents that the models count (`docs` is what
    `train` was given) are counted and scored by the same messages; for others the counted documents send
    theirs besides. Chunks and answers are written to the shared folder, so a lost executor costs no more than
    the stage that it was lost in.
    """
    joint = docs is models.source and text == models.text
    asking = models.packed if joint else _chunks(docs, docs.columns, text, F.lit(False), chunk)
    size = sum((p.agg(F.sum("bytes")).first()[0] or 0) for p in {id(p): p for p in (asking, models.packed)}.values())
    parts = int(size // (3 * part)) + 1  # there are about 3 characters for each hash that is sent
    say = lambda p, replies, counts: p.mapInArrow(partial(_ask, parts=parts, replies=replies, counts=counts), "part long, chunk long, blob binary")
    messages = say(asking, True, joint)
    if not joint:
        messages = messages.unionByName(say(models.packed, False, True))
    answers = messages.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_sum, "chunk long, part long, blob binary, size long, background long, target long")
    answers = written(answers)
    whole = answers.where("chunk < 0").agg(F.sum("size"), F.sum("background"), F.sum("target")).first()
    totals = Totals((whole[1] or 0, whole[2] or 0), whole[0] or 0)
    met = answers.where("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "part", "blob")
    met = met.unionByName(asking.select("chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), "blob"))
    met = met.repartition(max(1, asking.count()), "chunk").sortWithinPartitions("chunk", "kind", "part")
    kept = {c: "held" if c == text else f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in ADDED}
    fields = [T.StructField(c, T.StringType() if c == text else docs.schema[c].dataType) for c in kept]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType() if n == "n_words" else T.DoubleType()) for n in ADDED)])
    return met.mapInArrow(partial(_answered, totals=totals, sources=kept), schema)
