"""Near-duplicates by SimHash fingerprints, compared exactly in tiles.

Fingerprints are dealt to buckets, so that two within the radius meet in one: for three of 64 bits, one bucket
for every pair of five blocks of bits; for near copies, one for each of 16 bands of a longer fingerprint and
for each of its least certain bits. Inside a bucket they are sorted by population count and cut into tiles;
tile pairs whose counts differ by more than the radius are skipped, the others are compared by numpy's
exclusive-or and bit count. Large buckets are split by ranges of population counts first, and parts whose
ranges differ by more than the radius never meet, so no task holds a bucket whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpointed, fresh, sliced, with_group, written
from .components import components

SEED, WORDS, RADIUS = 42, 3, 3
#: Bits of the five blocks; two of them make a bucket's key of 25 or 26 bits.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a tile, and tile pairs that are compared at a time.
TILE, TOGETHER = 64, 512
#: Rows of cells that a task links at a time; a pair that meets in several of their cells is one link.
GATHERED = 200_000
#: A bucket with more fingerprints is split into parts of about this many.
PART = 2_048
#: Near copies: words of a shingle, the least Jaccard similarity as a fraction, bands of the fingerprint and their
#: bits, bits of each band that are also tried flipped, and the radius among the first 128 bits.
NEAR_WORDS, SIMILAR, BANDS, BAND_BITS, FLIPS, NEAR_RADIUS = 5, (4, 5), 16, 20, 3, 32
#: Shingles and documents of a part in which near copies are verified.
PART_SHINGLES, PART_DOCS = 250_000, 1_024


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that a hash stands for; the first are itself."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """XXH64 of the word shingles of one whole text, repeats included.

    The text's A-Z are lower-cased; words are runs of anything but space and U+0009 to U+000D. Fewer words
    than a shingle has are one shingle; none are none.
    """
    import xxhash

    own = text.encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own)) + 1
    ends = np.cumsum(size)
    k = min(words, len(own))
    starts = (ends - size)[: len(own) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def margins(h: np.ndarray, width: int = 1) -> np.ndarray:
    """Of each bit of a fingerprint of so many 64-bit words, how many more hashes have it than not."""
    ones = np.zeros((width, 64), np.int64)
    for at in range(0, len(h), 4096):
        for k in range(width):
            part = _mixed(h[at : at + 4096], k)
            ones[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * ones - len(h)


def _bits(margin: np.ndarray) -> np.ndarray:
    return np.packbits(margin > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of one whole text, from the XXH64 of its word shingles, repeats included; 0 without words."""
    return int(_bits(margins(shingles(text, words)))[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        f = np.array([fingerprint(t or "") for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != text), pa.array(f)], names=names)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number; a null text counts as empty."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(partial(_fingerprints, text="text", names=["doc_id", "fp"]), "doc_id long, fp long")


def dealt(rows: DataFrame, prints: list[str], radius: int, part: int = PART) -> DataFrame:
    """Rows (bucket and fingerprint words) with `count`, the population count, and `cell`, in which they are compared.

    A bucket of up to `part` rows is one cell. A larger one is split by population count, and a count that is
    itself too frequent by hash; a row goes to the cells in which its part meets itself and each part whose
    count is within the radius.
    """
    rows = rows.withColumn("count", sum((F.bit_count(p) for p in prints[1:]), F.bit_count(prints[0])))
    large = checkpointed(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("bucket"))
    if large.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    hot = rows.join(large, "bucket")
    counts = checkpointed(hot.groupBy("bucket", "count").agg(F.ceil(F.count(F.lit(1)) / part).cast("long").alias("subs")))
    every = F.flatten(F.transform(F.collect_list(F.struct("count", "subs")), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["subs"] - 1), lambda k: F.struct(x["count"].alias("count"), (F.shiftleft(x["count"].cast("long"), 20) + k).alias("side")))))
    met = hot.join(counts, ["bucket", "count"]).join(counts.groupBy("bucket").agg(every.alias("sides")), "bucket")
    own = F.shiftleft(F.col("count").cast("long"), 20) + F.pmod(F.xxhash64(*prints), F.col("subs"))
    near = F.filter("sides", lambda x: F.abs(x["count"] - F.col("count")) <= radius)
    cell = F.transform(near, lambda x: F.shiftleft(F.least(x["side"], F.col("own")), 31) + F.greatest(x["side"], F.col("own")))
    split = met.withColumn("own", own).select("bucket", *prints, "count", F.explode(cell).alias("cell"))
    return rows.join(large, "bucket", "left_anti").withColumn("cell", F.lit(0).cast("long")).unionByName(split)


def _least(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Of each of n rows the least one that the pairs connect it with."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, r, was[c])
        np.minimum.at(low, c, was[r])
        low = low[low]
        if (low == was).all():
            return low


def near_pairs(cell: np.ndarray, count: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pairs of rows of one cell within the radius, or as few that connect the same rows; and how many tile pairs were compared and skipped.

    Rows are sorted by cell, then count; `prints` has a row's 64-bit words. A tile holds rows of one or more
    cells, and two tiles have a cell in common only if the first ends and the second begins with it.
    """
    n = len(cell)
    tiles = -(-n // TILE)
    pad = tiles * TILE - n
    cells = np.append(cell, np.full(pad, -1)).reshape(tiles, TILE)
    words = np.concatenate([prints, np.zeros((pad, prints.shape[1]), np.uint64)]).reshape(tiles, TILE, -1)
    first, last = np.arange(tiles) * TILE, np.minimum(np.arange(1, tiles + 1) * TILE, n) - 1
    upper = np.triu(np.ones((TILE, TILE), bool), 1)
    low, high, compared, skipped = [], [], 0, 0
    left, apart = np.arange(tiles), 0
    while len(left):
        compared += len(left)
        for k in range(0, len(left), TOGETHER):
            i = left[k : k + TOGETHER]
            x, y = words[i], words[i + apart]
            far = sum(np.bitwise_count(x[:, :, None, w] ^ y[:, None, :, w]).astype(np.uint16) for w in range(prints.shape[1]))
            near = (far <= radius) & (cells[i][:, :, None] == cells[i + apart][:, None, :]) & (cells[i] >= 0)[:, :, None]
            if not apart:
                near &= upper
            t, r, c = np.nonzero(near)
            r, c = i[t] * TILE + r, (i[t] + apart) * TILE + c
            if len(r) > 4 * len(i) * TILE:  # dense: each row with the least that it is connected with
                of, at = np.unique(np.concatenate([r, c]), return_inverse=True)
                least = of[_least(at[: len(r)], at[len(r) :], len(of))]
                r, c = of[least != of], least[least != of]
            low.append(r), high.append(c)
        apart += 1
        left = left[left + apart < tiles]
        left = left[cell[last[left]] == cell[first[left + apart]]]
        ok = count[first[left + apart]] - count[last[left]] <= radius
        skipped += int((~ok).sum())
        left = left[ok]
    return np.concatenate([*low, np.zeros(0, np.int64)]), np.concatenate([*high, np.zeros(0, np.int64)]), compared, skipped


def _compare(batches: Iterator[pa.RecordBatch], radius: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links of cells, whose rows arrive sorted: some whole cells at a time; the rest of an unfinished cell waits for the next batch."""

    def links(bucket: np.ndarray, cell: np.ndarray, count: np.ndarray, *prints: np.ndarray) -> pa.RecordBatch:
        of = np.cumsum(np.append(True, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])))
        own = np.stack(prints, 1).view(np.uint64)
        r, c, *_ = near_pairs(of, count, own, radius)
        # Of all that these cells connect, each node is linked to the least one: a group gives no more links than it has nodes.
        node, at = np.unique(np.bitwise_xor.reduce(own, axis=1).view(np.int64), return_inverse=True)
        least = _least(at[r], at[c], len(node))
        pairs = np.stack([node[least], node])[:, least != np.arange(len(node))]
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    rest = [np.zeros(0, np.int64) for _ in range(3 + width)]
    for batch in batches:
        rest = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(rest)]
        if len(rest[0]) < GATHERED:
            continue
        ended = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
        if len(ended):
            cut = int(ended[-1]) + 1
            yield links(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if len(rest[0]):
        yield links(*rest)


def _linked(rows: DataFrame, prints: list[str], radius: int, part: int) -> DataFrame:
    """(a, b) of nodes (the exclusive-or of a fingerprint's words) that share a bucket and lie within the radius."""
    cells = dealt(rows, prints, radius, part).select("bucket", "cell", F.col("count").cast("long").alias("count"), *prints)
    cells = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "count")
    return contracted(cells.mapInArrow(partial(_compare, radius=radius, width=len(prints)), "a long, b long"))


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (a, b), a < b, that connect the same nodes.

    A node gets a link from each task that it meets others in, to the least of them. It keeps the one to the
    least of all; the others' ends, which are few and the same for many nodes, are linked with that one instead.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    met = written(links.distinct().withColumn("least", least))
    others = met.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return met.select(F.col("least").alias("a"), "b").distinct().unionByName(others.distinct()).distinct()


def near_links(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(a, b) of fingerprints (fp), so that two are connected by these links if and only if they are by all pairs within the radius, of three bits at most."""
    keys = []
    for k, (x, y) in enumerate(combinations(BLOCKS, 2)):
        value = F.lit(k).cast("long")
        for start, bits in (x, y):
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(value)
    return _linked(distinct.select("fp", F.explode(F.array(*keys)).alias("bucket")), ["fp"], radius, part)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fp, component_id.

    component_id is the smallest doc_id among all documents that links within three bits reach, itself
    included; a null doc_id is never chosen unless there is no other. Equal fingerprints (copies, texts
    without words) are one node, so copies are not expanded into pairs. An empty table gives none.
    """
    own = checkpointed(fingerprints(docs, doc_id, text))
    nodes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(near_links(nodes.select("fp")))
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    of_node = nodes.join(of_node, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return with_group(own, checkpointed(of_node), "fp", "copies", own.count()).select("doc_id", "fp", "component_id")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the first two words of its long fingerprint, the buckets that it goes to, and the number of its shingles."""
    width = -(-BANDS * BAND_BITS // 64)
    power = 1 << np.arange(BAND_BITS)
    for batch in sliced(batches):
        prints, keys, size = [], [], []
        for t in batch.column("text").to_pylist():
            h = np.unique(shingles(t or "", NEAR_WORDS))
            own = margins(h, width)
            bands = own.ravel()[: BANDS * BAND_BITS].reshape(BANDS, BAND_BITS)
            value = (bands > 0) @ power
            unsure = np.argsort(np.abs(bands), axis=1, kind="stable")[:, :FLIPS]
            tried = np.concatenate([value[:, None], value[:, None] ^ (1 << unsure)], axis=1) + (np.arange(BANDS) << BAND_BITS)[:, None]
            prints.append(_bits(own[:2]).view(np.int64))
            keys.append(tried.ravel().astype(np.int32))
            size.append(len(h))
        f = np.array(prints, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int32()))], names=["doc_id", "f0", "f1", "size", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        own = [np.unique(shingles(t or "", NEAR_WORDS)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("root", "parts", "doc_id")), pa.array(own, pa.binary())], names=["root", "parts", "doc_id", "shingles"])


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of at least `SIMILAR`, as many as connect all that are; two empty sets are alike.

    A set meets all others at once, by the sets that each of its members is in; sets that are connected
    already need no pair of their own.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(n), size)
    _, member, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    holders = doc[np.argsort(member, kind="stable")]
    ends = np.cumsum(often)
    label, found, at = np.arange(n), [], 0
    for i in range(n):
        own = member[at : at + size[i]]
        at += size[i]
        own = own[often[own] > 1]
        if i and (label == label[0]).all():
            break
        reach = often[own]
        places = np.repeat(ends[own] - np.cumsum(reach), reach) + np.arange(reach.sum())
        both = np.bincount(holders[places], minlength=n)
        if size[i]:
            both[i] = size[i]
        near = np.flatnonzero(both * SIMILAR[1] >= (size[i] + size - both) * SIMILAR[0])
        names, first = np.unique(label[near], return_index=True)
        found += [(i, int(near[k])) for k, name in zip(first, names, strict=True) if name != label[i]]
        label[np.isin(label, names)] = names[0] if len(names) else label[i]
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of documents, whose rows arrive in order of group and cell."""

    def links(ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        pairs = alike([np.frombuffer(b, np.uint64) for b in blobs])
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    key, ids, blobs = None, [], []
    for batch in batches:
        for root, cell, i, blob in zip(*(batch.column(n).to_pylist() for n in ("root", "cell", "doc_id", "shingles")), strict=True):
            if (root, cell) != key and ids:
                yield links(ids, blobs)
                ids, blobs = [], []
            key = root, cell
            ids.append(i)
            blobs.append(blob)
    if ids:
        yield links(ids, blobs)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = PART, part_docs: int = PART_DOCS) -> DataFrame:
    """(doc_id, component_id) of the documents that have near copies: component_id is the smallest doc_id among all that links reach.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8; two
    without words are. Candidates come from fingerprints of 320 bits: a document goes to a bucket for each of
    16 bands of 20 bits, and to those in which one of the band's three least certain bits is flipped; in a
    bucket, first halves within 32 of 128 bits connect documents. Each group that is connected so is verified
    whole by its shingles, in parts. Rows with a null doc_id are left out; rows that share one are one document.
    An empty table gives none.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    own = checkpointed(plain.mapInArrow(_sketch, "doc_id long, f0 long, f1 long, size long, keys array<int>").withColumn("node", F.col("f0").bitwiseXOR(F.col("f1"))))
    nodes = own.groupBy("node").agg(F.min(F.struct("f0", "f1", "keys")).alias("x"), F.count(F.lit(1)).alias("copies"), F.sum("size").alias("size"))
    nodes = checkpointed(nodes.select("node", "x.f0", "x.f1", "x.keys", "copies", "size"))
    buckets = nodes.select("f0", "f1", F.explode(F.col("keys").cast("array<bigint>")).alias("bucket"))
    roots = components(_linked(buckets, ["f0", "f1"], NEAR_RADIUS, part))
    of_node = checkpointed(nodes.join(roots, "node", "left").select("node", "copies", "size", F.coalesce("root", "node").alias("root")))
    parts = F.greatest(F.ceil(F.sum("size") / PART_SHINGLES), F.ceil(F.sum("copies") / part_docs)).cast("long")
    several = of_node.groupBy("root").agg(F.sum("copies").alias("n"), parts.alias("parts")).where("n > 1")
    chosen = with_group(of_node.select("node", "root", "copies"), checkpointed(several), "root", "n", of_node.count())
    chosen = checkpointed(chosen.select("node", "root", "copies", "parts"))
    members = checkpointed(with_group(own.select("doc_id", "node"), chosen, "node", "copies", own.count()).select("doc_id", "root", "parts").distinct())
    sets = bitmap.within(plain, "doc_id", members, "doc_id").mapInArrow(_sets, "root long, parts long, doc_id long, shingles binary")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.least(k, mine) * F.col("parts") + F.greatest(k, mine))
    spread = sets.select("root", "doc_id", "shingles", F.explode(cells).alias("cell"))
    pairs = spread.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(_verify, "a long, b long")
    return components(pairs.where("a <> b")).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group of near copies the one with the smallest doc_id, with all its columns.

    See `near_copies`. A row with a null doc_id stays, as no id names it; rows that share a doc_id share the
    decision, which goes by all their texts.
    """
    (key,) = fresh(docs.columns, "key")
    gone = near_copies(docs, doc_id, text).where("doc_id <> component_id")
    return bitmap.without(docs.withColumn(key, F.col(doc_id).cast("long")), key, gone, "doc_id").drop(key)
