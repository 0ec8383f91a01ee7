"""A prefix trie of conversations, built compressed (Patricia) from sorted sequences and expanded at the end.

A conversation is a sequence of turns; a turn is 16 bytes of the digest of its role and text. Equal sequences are
one row with a count before anything is sorted. The distinct sequences are sorted by range, and each task walks
its range once with a stack: a node is made only where two neighbours part, where a sequence ends, or for a leaf.
What is summed for a node is linear in its members, so the parts of a node that lie in several ranges are added up
by its digest. Only then the turns inside an edge become nodes of their own, by sums along the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sliced, with_group, written

#: Bytes of a turn in a sequence's key.
TURN = 16
#: Ids of one row while members are listed are alike but for so many bits: at most 4,096.
RANGE_BITS = 12

#: The columns of `nodes`.
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, turn_key, size): the turns of each conversation from position 1, a null turn number first.

    Ties of turn go by role, then text; null roles and texts are empty. Turns of a null conv_id belong to no
    conversation and give no row. `turn_key` is the digest of role and text, `size` the text's UTF-8 bytes.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    own = own.where(F.col("conv_id").isNotNull())
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    own = own.withColumn("turn_key", F.substring(F.unhex(F.sha2(whole, 256)), 1, TURN)).withColumn("size", F.octet_length("text").cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return own.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text", "turn_key", "size")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as an array of (pos, turn_key, size).

    A conversation is one row of some 30 bytes a turn, as a document is one row; its texts don't go along.
    """
    turn = F.struct("pos", "turn_key", "size")
    return ranked(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("seq"))


def rebuilt(own: DataFrame, origin: Column, shared: Column, most: int) -> DataFrame:
    """`own` (conv_id, seq) with the first `shared` turns (at most `most`) of the conversation `origin` in place of its own first ones.

    Where the origin is absent nothing takes their place; a sequence may become empty. No conversation should be
    the origin of very many: the join is by its id.
    """
    heads = own.select(F.col("conv_id").alias("origin"), F.slice("seq", 1, most).alias("head"))
    both = own.withColumn("origin", origin).withColumn("shared", shared.cast("int")).join(heads, "origin", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("shared")), F.slice("seq", 1, 0))
    tail = F.slice("seq", F.col("shared") + 1, F.greatest(F.size("seq") - F.col("shared"), F.lit(0)))
    return both.select("conv_id", F.concat(head, tail).alias("seq"))


def _joined(own: Column) -> Column:
    """The bytes of a sequence's turns, one after another."""
    return F.unhex(F.array_join(F.transform(own, lambda t: F.hex(t["turn_key"])), ""))


def grouped(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (id, key, sizes, n, conv_id, ids, parts), and the rows of ids (id, part, ids) that they were summed from.

    `ids` of a sequence is the list of its members where one range of ids holds them all.
    """
    flat = own.select("conv_id", _joined(F.col("seq")).alias("key"), F.col("seq.size").alias("sizes"))
    flat = flat.select("*", F.unhex(F.sha2("key", 256)).alias("id"), F.shiftright("conv_id", RANGE_BITS).alias("part"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = flat.groupBy("id", "part").agg(
        F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), listed.alias("ids")
    )
    parts = written(parts)
    whole = parts.groupBy("id").agg(
        F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.min("ids").alias("ids"), F.count(F.lit(1)).alias("parts"),
    )
    return whole, parts.select("id", "part", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each id's lists, which come in order; only the hash's state is held."""
    last, state, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["id", "ends"])
            done = []
    if last is not None:
        done.append((last, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["id", "ends"])


def _ends(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, ends): the digest of the ids of a sequence's members in order.

    SHA-256 reads its input in one order, so the ids of one sequence with very many members pass through one task, as a
    stream of rows of up to 4,096 ids that others have sorted and joined.
    """
    one = whole.where("parts = 1").select("id", F.sha2("ids", 256).alias("ends"))
    long = parts.join(whole.where("parts > 1").select("id"), "id", "left_semi")
    long = long.repartition("id").sortWithinPartitions("id", "part")
    return one.unionByName(long.mapInArrow(_digests, "id binary, ends string"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


def falling(depths: list[int], depth: int) -> list[int]:
    """A rising list of depths, cut to at most `depth`, with `depth` at its end."""
    out = [d for d in depths if d < depth]
    out.append(depth)
    return out


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's first and last key, and the least common depths from its start on and up to its end."""
    first = last = None
    ahead: list[int] = []  # least depths from the first key on, each lower than the one before
    behind: list[int] = []  # least depths up to the last key, rising
    for batch in sliced(batches):
        for key in batch.column("key").to_pylist():
            if first is None:
                first = key
            else:
                depth = common(last, key)
                if not ahead or depth < ahead[-1]:
                    ahead.append(depth)
                behind = falling(behind, depth)
            last = key
    if first is not None:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "ahead": pa.array([ahead], pa.list_(pa.int32())), "behind": pa.array([behind], pa.list_(pa.int32()))})


def spines(summaries: list) -> dict[int, tuple[int, list[int], list[int]]]:
    """Of each range: the depth shared with the key before it (-1: none), and the depths at which the path to its first and last key parts elsewhere.

    The summaries are one row a range: their number is that of partitions, and their size that of two conversations.
    """
    before, after = {}, {}
    chain: list[int] = []
    for k, s in enumerate(summaries):
        shared = common(summaries[k - 1]["last"], s["first"]) if k else -1
        chain = falling(chain, shared) if k else []
        before[s["at"]] = (shared, list(chain))
        for depth in s["behind"]:
            chain = falling(chain, depth)
    chain = []
    for k in range(len(summaries) - 1, -1, -1):
        s = summaries[k]
        chain = falling(chain, common(s["last"], summaries[k + 1]["first"])) if k + 1 < len(summaries) else []
        after[s["at"]] = chain[::-1]
        for depth in s["ahead"][::-1]:
            chain = falling(chain, depth)
    return {at: (*before[at], after[at]) for at in before}


class _Point:
    """A node of the compressed tree on the path to the current key: what its members in this range add up to."""

    __slots__ = ("depth", "state", "n", "conv", "leaves", "weighted", "new", "entry", "forks", "end")

    def __init__(self, depth, state):
        self.depth, self.state = depth, state
        self.n = self.leaves = self.weighted = self.new = self.entry = self.forks = 0
        self.conv, self.end = None, False

    def add(self, other: _Point) -> None:
        self.n += other.n
        self.leaves += other.leaves
        self.weighted += other.weighted
        self.new += other.new
        self.conv = other.conv if self.conv is None else self.conv if other.conv is None else min(self.conv, other.conv)


POINT = "id binary, depth long, parent binary, n long, conv_id long, leaves long, weighted long, new long, entry long, forks long, is_end boolean, edge array<long>"
_POINT = pa.schema([("id", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), *((x, pa.int64()) for x in ("n", "conv_id", "leaves", "weighted", "new", "entry", "forks")), ("is_end", pa.bool_()), ("edge", pa.list_(pa.int64()))])


class Walk:
    """One pass over sorted distinct sequences; `rows` are the points that it has left, each with its sums.

    A point's sums: n members, the least conv_id, leaves; `weighted` the text bytes of all members; `new` the bytes of
    the turns that a member shares with no sequence before it; `entry` the bytes of the turns that its first member
    shares with the sequence before (0 in the parts that don't hold the first); `forks` the sequences that part here
    from the one before. `edge` holds the bytes of the path before each turn of the edge.
    """

    def __init__(self, shared: int, before: list[int], first: bytes):
        root = _Point(0, hashlib.sha256())
        self.stack, self.rows, self.key, self.sums = [root], [], first, np.zeros(1, np.int64)
        self.shared, self.begun = shared, False
        for depth in before:
            if depth > 0:
                self.stack.append(self._at(depth, first))

    def _at(self, depth: int, key: bytes) -> _Point:
        top = self.stack[-1]
        state = top.state.copy()
        state.update(key[top.depth * TURN : depth * TURN])
        return _Point(depth, state)

    def _back(self, depth: int) -> None:
        """Leave the points below `depth`; a point at `depth` is on the stack after that."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                between = self._at(depth, self.key)
                between.entry = point.entry
                self.stack.append(between)
            above = self.stack[-1]
            above.add(point)
            self._leave(point, above)

    def _leave(self, point: _Point, above: _Point | None) -> None:
        edge = [0] if above is None else self.sums[above.depth : point.depth].tolist()
        parent = None if above is None else above.state.digest()
        self.rows.append((point.state.digest(), point.depth, parent, point.n, point.conv, point.leaves, point.weighted, point.new, point.entry, point.forks, point.end, edge))

    def step(self, key: bytes, sizes: list[int], n: int, conv: int, last: bool) -> None:
        """The next sequence; `last` if no later one begins with it."""
        depth = common(self.key, key) if self.begun else self.shared
        if depth >= 0:
            self._back(depth)
            self.stack[-1].forks += 1
        depth = max(depth, 0)
        self.begun, self.key = True, key
        self.sums = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]) if sizes else np.zeros(1, np.int64)
        length = len(key) // TURN
        if length > self.stack[-1].depth:
            point = self._at(length, key)
            point.entry = int(self.sums[depth])
            self.stack.append(point)
        own = _Point(length, None)
        own.n, own.conv, own.leaves = n, conv, int(last)
        own.weighted, own.new = n * int(self.sums[-1]), int(self.sums[-1] - self.sums[depth])
        self.stack[-1].add(own)
        self.stack[-1].end = True

    def finish(self, after: list[int]) -> None:
        """Leave all points, with those where later ranges part from this one's last path (depths falling)."""
        for depth in after:
            self._back(depth)
        while self.stack:
            point = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if above is not None:
                above.add(point)
            self._leave(point, above)


def _points(batches: Iterator[pa.RecordBatch], paths: dict[int, tuple[int, list[int], list[int]]], following: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId()
    walk = held = None

    def rows() -> Iterator[tuple]:
        for batch in sliced(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "n", "conv_id")), strict=True)

    def out() -> pa.RecordBatch:
        columns = list(zip(*walk.rows, strict=True)) if walk.rows else [()] * len(_POINT)
        walk.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _POINT, strict=True)], schema=_POINT)

    for row in rows():
        if held is None:
            walk = Walk(paths[at][0], paths[at][1], row[0])
        else:
            walk.step(*held, last=not row[0].startswith(held[0]))
        held = row
        if len(walk.rows) >= 10_000:
            yield out()
    if held is not None:
        walk.step(*held, last=not following.get(at, b"").startswith(held[0]) if at in following else True)
        walk.finish(paths[at][2])
        yield out()


def points(whole: DataFrame) -> DataFrame:
    """The compressed tree of distinct sequences (key, sizes, n, conv_id): one row for each branch point, end and leaf, and the root."""
    ordered = checkpointed(whole.select("key", "sizes", "n", "conv_id").orderBy("key"))
    summaries = ordered.select("key").mapInArrow(_summary, "at int, first binary, last binary, ahead array<int>, behind array<int>")
    found = sorted((r.asDict() for r in summaries.collect()), key=lambda r: r["at"])
    paths = spines(found)
    following = {a["at"]: b["first"] for a, b in zip(found, found[1:], strict=False)}
    parts = ordered.mapInArrow(lambda batches: _points(batches, paths, following), POINT)
    return parts.groupBy("id").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("edge").alias("edge"), F.max("is_end").alias("is_end"),
        *[F.sum(c).alias(c) for c in ("n", "leaves", "weighted", "new", "entry", "forks")],
    )


def nodes(own: DataFrame) -> DataFrame:
    """The trie of `own` (conv_id, seq), one row for each node: COLUMNS.

    A node is a distinct beginning of sequences, from the root (depth 0) on; conv_id is its smallest member,
    parent_conv_id its parent's (root: null). n_convs counts members, n_children child nodes, n_leaves childless nodes
    of its subtree; saved_tokens sums over its subtree (n_convs - 1) times the bytes of a node's last text;
    ends_sha256 is the digest of the ids of the members that end here. Conversation ids are distinct. No rows give no node.

    No hot group is one task's: equal sequences are one row, a range of sorted sequences ends anywhere in a subtree,
    sums are partial before they move, and parents of very many nodes are broadcast (`with_group`).
    """
    whole, parts = grouped(own)
    whole = written(whole)
    tree = written(points(whole))
    total = tree.count()
    above = tree.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("forks") + 1).alias("children"))
    linked = with_group(tree.where("depth > 0"), above, "parent", "children", max(total, 1))
    root = tree.where("depth = 0").select(*tree.columns, F.lit(None).cast("long").alias("parent_conv_id"))
    full = linked.select(root.columns).unionByName(root).join(_ends(whole, parts), "id", "left")
    before = F.element_at("edge", -1)
    # (n_convs - 1) times bytes, summed over the subtree: over members, less once for each distinct turn.
    saved = F.col("weighted") - F.col("n") * before - (F.col("new") + F.col("entry") - before)
    children = F.col("forks") + F.when(F.col("is_end"), 0).otherwise(1)
    full = full.select("*", saved.alias("saved"), children.alias("children"), before.alias("before"), F.posexplode("edge").alias("j", "bytes"))
    top, bottom = F.col("j") == 0, F.col("j") == F.size("edge") - 1
    return full.select(
        "conv_id",
        (F.col("depth") - F.size("edge") + 1 + F.col("j")).alias("depth"),
        F.when(top, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("before") - F.col("bytes"))).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def last_turns(found: DataFrame, turns: DataFrame) -> DataFrame:
    """`found` nodes of conversations as they are (not `rebuilt`) with the role and text of each node's last turn; the root has none."""
    own = ranked(turns).select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text")
    return found.join(own, ["conv_id", "depth"], "left")
