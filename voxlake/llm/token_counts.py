"""Token counts that follow edits: only what an edit touches is encoded again.

The pre-tokens of a document are the leaves of a tree whose nodes hold sums of characters and tokens. An edit
re-splits the text from a little before its start until a new boundary meets an old one; the leaves between
are replaced, and only the sums above them change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sliced

#: Characters after the end of a pre-token that its split may have looked at.
AHEAD = 3
#: Pre-tokens in one leaf, and the depth at which a tree is balanced anew.
LEAF, DEEPEST = 32, 60
REMEMBERED = 100_000


class Counter(dict):
    """Tokens of each pre-token, remembered up to a bound."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class Node:
    """A leaf with the lengths and token counts of some pre-tokens, or the sums of two subtrees."""

    __slots__ = ("chars", "tokens", "depth", "left", "right", "sizes", "counts")

    def __init__(self, left=None, right=None, sizes=(), counts=()):
        self.left, self.right, self.sizes, self.counts = left, right, sizes, counts
        if left is None:
            self.chars, self.tokens, self.depth = sum(sizes), sum(counts), 0
        else:
            self.chars, self.tokens, self.depth = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.depth, right.depth)


def joined(a: Node | None, b: Node | None) -> Node | None:
    return a if b is None else b if a is None else Node(a, b)


def built(sizes: list[int], counts: list[int]) -> Node | None:
    """A balanced tree over pre-tokens."""
    level = [Node(None, None, sizes[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(sizes), LEAF)]
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def boundary(node: Node | None, at: int) -> int:
    """The last boundary at or before a character."""
    base = 0
    while node is not None and node.left is not None:
        if at - base >= node.left.chars:
            base += node.left.chars
            node = node.right
        else:
            node = node.left
    for size in node.sizes if node else ():
        if base + size > at:
            break
        base += size
    return base


def cut(node: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """The trees before and after a boundary."""
    if node is None or at <= 0:
        return None, node
    if at >= node.chars:
        return node, None
    if node.left is not None:
        if at < node.left.chars:
            a, b = cut(node.left, at)
            return a, joined(b, node.right)
        a, b = cut(node.right, at - node.left.chars)
        return joined(node.left, a), b
    k, base = 0, 0
    while base < at:
        base += node.sizes[k]
        k += 1
    return Node(None, None, node.sizes[:k], node.counts[:k]), Node(None, None, node.sizes[k:], node.counts[k:])


def leaves(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        x = stack.pop()
        if x.left is None:
            yield x
        else:
            stack += [x.right, x.left]


class CountedText:
    """A text with its tree; `edit` keeps both in step. A tree that was kept is taken as it is."""

    def __init__(self, text: str, pattern, counter: Counter, kept: tuple[list[int], list[int]] | None = None):
        self.text, self.pattern, self.counter = text, pattern, counter
        if kept is None:
            pieces = pattern.findall(text)
            kept = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
        self.tree = built(*kept)
        self.encoded = 0

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token, from which `built` makes the tree again."""
        own = list(leaves(self.tree))
        return [s for x in own for s in x.sizes], [c for x in own for c in x.counts]

    @property
    def tokens(self) -> int:
        return self.tree.tokens if self.tree else 0

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put `new` in place of the characters from start to stop, clipped to the text."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        shift = len(new) - (stop - start)
        low = boundary(self.tree, start - AHEAD) if start > AHEAD else 0
        self.text = self.text[:start] + new + self.text[stop:]
        sizes, counts, high = [], [], low
        for found in self.pattern.finditer(self.text, low):
            sizes.append(len(found[0]))
            counts.append(self.counter[found[0]])
            high = found.end()
            if high - shift >= stop and high >= start + len(new) and boundary(self.tree, high - shift) == high - shift:
                break
        self.encoded += len(sizes)
        before, rest = cut(self.tree, low)
        _, after = cut(rest, high - shift - low)
        self.tree = joined(joined(before, built(sizes, counts)), after)
        if self.tree and self.tree.depth > DEEPEST:
            own = list(leaves(self.tree))
            self.tree = built([s for x in own for s in x.sizes], [c for x in own for c in x.counts])


@lru_cache(maxsize=2)
def splitter(path: str, pattern: str):
    """The pre-token pattern and counter of a rank file, once for each Python worker."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern), Counter(encoding.encode_ordinary)


ADDED = ("n_tokens", "n_tokens_edited", "n_pieces_encoded")


def _edited(own: CountedText, changes: list | None) -> None:
    for x in changes or ():
        if x is not None:
            start = x["start"] or 0
            own.edit(start, start if x["stop"] is None else x["stop"], x["new"] or "")


def _segment(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    split, counter = splitter(path, pattern)
    for batch in sliced(batches):
        sizes, counts, tokens = [], [], []
        for t in batch.column(text).to_pylist():
            pieces = split.findall(t or "")
            sizes.append(np.fromiter(map(len, pieces), "<u4", len(pieces)).tobytes())
            own = np.fromiter(map(counter.__getitem__, pieces), "<u4", len(pieces))
            counts.append(own.tobytes())
            tokens.append(int(own.sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.binary()), pa.array(counts, pa.binary()), pa.array(tokens, pa.int64())], names=names)


#: Columns of a document's kept tree: characters and tokens of each pre-token, four bytes each, and their sum.
TREE = ("piece_sizes", "piece_counts", "n_tokens")


def segment(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with the leaves of each text's tree and their sum (TREE), to be kept with the text; see `edit`.

    Null texts are empty. Columns with these names are replaced; all others pass through. One narrow stage.
    """
    kept = docs.select([c for c in docs.columns if c.lower() not in TREE or c == text])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.BinaryType()) for n in TREE[:2]), T.StructField(TREE[2], T.LongType())])
    return kept.mapInArrow(partial(_segment, path=tokenizer, pattern=pattern, text=text, names=schema.names), schema)


def _edit(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, edits: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    split, counter = splitter(path, pattern)
    for batch in sliced(batches):
        out = []
        for t, sizes, counts, changes in zip(*(batch.column(c).to_pylist() for c in (text, *TREE[:2], edits)), strict=True):
            if not any(x is not None for x in changes or ()):
                out.append((t, sizes, counts, int(np.frombuffer(counts, "<u4").sum()), 0))
                continue
            own = CountedText(t or "", split, counter, (np.frombuffer(sizes, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist()))
            _edited(own, changes)
            sizes, counts = own.kept()
            out.append((own.text, np.array(sizes, "<u4").tobytes(), np.array(counts, "<u4").tobytes(), own.tokens, own.encoded))
        new = dict(zip((text, *TREE, "n_pieces_encoded"), (zip(*out, strict=True) if out else [()] * 5), strict=True))
        kinds = dict(zip(new, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(new[n], kinds[n]) if n in new else batch.column(n) for n in names], names=names)


def edit(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """`docs` that `segment` or this function has made, with texts and trees after their edits, and the pre-tokens encoded for them.

    Edits are as in `count_edited`. A tree is built from the kept leaves, so nothing is encoded but what edits
    touch; n_tokens counts the new text. A document without edits is passed as it is.
    """
    kept = docs.select([c for c in docs.columns if c.lower() != "n_pieces_encoded" or c in (text, edits)])
    schema = T.StructType([*kept.schema.fields, T.StructField("n_pieces_encoded", T.LongType())])
    return kept.mapInArrow(partial(_edit, path=tokenizer, pattern=pattern, text=text, edits=edits, names=schema.names), schema)


def count_edited(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """`docs` with the token count of each whole text, the count after its edits, and the pre-tokens encoded for the edits.

    `edits` is an array of (start int, stop int, new string), applied in order; offsets are code points of the
    text as the edits before have left it, clipped to it. Null texts are empty, null edits and parts of them
    are no change, an insertion at 0 or nothing. Equal rows count alike. Columns with these names are
    replaced; all others pass through. Trees are made by `segment` and edited by `edit`, in one narrow stage.
    """
    own = docs.select([c for c in docs.columns if c.lower() not in (*ADDED, *TREE) or c in (text, edits)])
    names = fresh(own.columns, "before", "edited_text")
    made = segment(own.withColumn(names[1], F.col(text)), tokenizer, pattern, names[1]).withColumn(names[0], F.col("n_tokens"))
    made = edit(made, tokenizer, pattern, names[1], edits)
    return made.select(*own.columns, F.col(names[0]).alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_pieces_encoded")
