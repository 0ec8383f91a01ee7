"""Packing of documents into sequences of a fixed number of tokens: best-fit decreasing with certified bounds.

Pieces are dealt evenly to partitions, whatever their keys. A partition packs its pieces by best fit in decreasing
order, and lower bounds by dual feasible functions tell how many sequences any packing of them needs. Where the
count equals the bound, the packing is certified and stays, but for its emptiest sequence. Partitions with a gap keep
their full sequences; the documents of all others go to the next round with those emptiest sequences, are dealt anew
and packed again.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced, written

#: Tokens of a sequence, the token that ends a document, and pieces that one partition packs.
CAPACITY, END, GROUP = 2_048, 0, 50_000
#: The string that the tokenizer reads as one token of its own, and its id.
SPECIAL = {"<|endoftext|>": 50_256}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The byte-pair encoder of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _cut(batches: Iterator[pa.RecordBatch], path: str, pattern: str, capacity: int, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder = encoding(path, pattern)
    for batch in sliced(batches):
        columns: list[list] = [[] for _ in schema]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
            pieces = -(-len(ids) // capacity)
            short = len(ids) - capacity * (pieces - 1)
            for k in range(pieces):
                start = 0 if k == 0 else short + capacity * (k - 1)
                own = ids[start : short + capacity * k]
                row = (doc_id, k, start, len(own), zlib.crc32(own.tobytes()), own)
                for column, value in zip(columns, row, strict=False):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's whole text, with `ids` if they are kept.

    A document is its token ids and `end`; a null text is empty, so it is `end` alone. Longer documents are cut
    into pieces of `capacity` tokens, the first of which may be shorter. Rows with equal ids are documents of their own.
    One narrow stage.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields, kept = [*fields, ("ids", pa.list_(pa.int64()))], f"{kept}, ids array<long>"
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(partial(_cut, path=ranks, pattern=pattern, capacity=capacity, end=end, schema=pa.schema(fields)), kept)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room): the bin and place of each piece, and what stays free in each bin, by best fit in decreasing order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have
    some, room = 0, []  # a bit for each room that some bin has
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            left, k = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = k, capacity - left
        left -= size
        room[k] = left
        if left:
            free[left].append(k)
            some |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound by two families of dual feasible functions, in whole numbers.

    `histogram[s]` counts the pieces of s tokens. One family drops pieces below k and takes those above capacity - k
    as whole bins; k = 0 gives the sum of lengths. The other rounds a piece's share of a bin down to multiples of 1 / k,
    unless it is a multiple of 1 / (k + 1).
    """
    h = histogram.astype(object) if histogram.sum() > 2**40 else histogram.astype(np.int64)
    size = np.arange(capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * size)])
    k = np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - k + 1]
    middle = total[capacity - k + 1] - total[k]
    best = int(np.max(-(-(whole * capacity + middle) // capacity)))
    for k in range(1, 101):
        share = size * (k + 1)
        value = np.where(share % capacity == 0, size * k, share // capacity * capacity)
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    return best


def _pack(batches: Iterator[pa.RecordBatch], length: str, capacity: int, turn: int, last: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lengths = np.concatenate([b.column(length).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
    bins, offsets, room = best_fit(lengths, capacity)
    certified = len(room) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    settled = np.full(len(room), True) if certified or last else room == 0
    if not last and room.max() > 0:
        settled[room.argmax()] = False
    first = (turn << 56) + (TaskContext.get().partitionId() << 24)
    at = 0
    for batch in held:
        own = slice(at, at + batch.num_rows)
        at += batch.num_rows
        added = [pa.array(first + bins[own]), pa.array(offsets[own]), pa.array(np.full(batch.num_rows, certified)), pa.array(settled[bins[own]])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP, rounds: int = 4) -> DataFrame:
    """`rows` with the sequence that each goes to, its offset there, and whether its partition's count of sequences is proven to be the least.

    Lengths are from 1 to `capacity`. Rows are dealt round-robin, so equal keys are no burden, and a task holds
    `group` rows. A round that needs more sequences than the one before for the same rows is not taken. After
    `rounds` rounds the rest stays as it is packed. All columns pass through; columns with the names that are added
    (sequence_id, offset, certified) are replaced. No rows give none.
    """
    (settled,) = fresh(rows.columns, "settled")
    added = ("sequence_id", "offset", "certified", settled)
    kept = rows.select([c for c in rows.columns if c.lower() not in added])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.LongType()) for n in added[:2]), *(T.StructField(n, T.BooleanType()) for n in added[2:])])
    pool, before, done = written(kept), None, []
    for turn in range(rounds):
        parts = max(1, -(-pool.count() // group))
        last = turn == rounds - 1 or parts == 1
        run = partial(_pack, length=length, capacity=capacity, turn=turn, last=last, names=schema.names)
        packed = written(pool.select(kept.columns).repartition(parts).mapInArrow(run, schema))
        # A sequence's first piece stands for it.
        count = packed.where("offset = 0").count()
        if before is not None and count > before:
            done.append(pool)
            break
        done.append(packed.where(settled))
        pool = packed.where(~F.col(settled))
        if last:
            break
        before = pool.where("offset = 0").count()
        if not before:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop(settled)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, of pieces whose ids were kept. A sequence has `capacity` ids at most."""
    piece = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.flatten(F.array_sort(F.collect_list(piece))["ids"]).alias("ids"))


def least(rows: DataFrame, length: str = "length", capacity: int = CAPACITY) -> int:
    """Sequences that any packing of all rows needs; the driver sees one count for each length."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy(F.col(length).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["size"]] = r["n"]
    return lower_bound(histogram, capacity)
