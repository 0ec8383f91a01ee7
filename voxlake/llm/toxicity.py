"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has a learning rate of its own, and the L1 term leaves weights only where the labels speak
for them, so the weights that are broadcast stay few, and are bounded by the hashed dimension in any case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, one_each, sliced

#: Documented bounds of the training: labelled rows sampled, passes over them, hashed dimensions.
SAMPLE = 8_000
EPOCHS = 8
BITS = 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
#: Documents of the sample that must have an n-gram before it gets a weight.
MIN_DOCS = 4
#: Letters of a word's stems.
STEMS = (4, 5, 6, 7)

#: ASCII other than letters and digits separates words.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[-1]), len(parts), np.uint64)
    for x in parts:
        h = (h ^ x) * ODD
        h ^= h >> np.uint64(29)
    return (h * ODD) >> np.uint64(64 - BITS)


def grams(text: str) -> np.ndarray:
    """Hashed words, word stems, word pairs and pairs that skip one or two words, of one whole text.

    A stem is a word's first letters; stems carry over to endings that no labelled document has.
    """
    words = text.lower().encode("utf-8", "replace").translate(BREAKS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    skipped = [_mix(np.full(max(0, len(h) - k), k, np.uint64), h[:-k], h[k:]) for k in (1, 2, 3) if len(h) > k]
    stems = {w[:k] for k in STEMS for w in set(words) if len(w) > k}
    skipped.append(_mix(np.full(len(stems), 9, np.uint64), np.fromiter(map(zlib.crc32, stems), np.uint64, len(stems))))
    return np.concatenate([_mix(h), *skipped]).astype(np.int32) if len(h) else np.zeros(0, np.int32)


@dataclass(frozen=True)
class ToxicityModel:
    """The weights that L1 has left, by hashed dimension."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.index] = self.weight
        return table

    def score(self, found: np.ndarray, table: np.ndarray) -> float:
        """0 to 1; each dimension counts once, however often the text has it."""
        own = np.unique(found[table[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + table[own].sum(), -50, 50))))


def fit(rows: list[np.ndarray], y: list[int]) -> ToxicityModel:
    """FTRL-proximal over documents, given as distinct hashed dimensions, in the order given.

    Without documents of both labels nothing is learnt: every score is the share of toxic labels, or 0.
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 50.0 if 1 in y else -50.0)
    # What few documents have can only be learnt by heart, and would leave nothing to learn from the rest.
    common = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= MIN_DOCS
    own = [np.append(x[common[x]], 1 << BITS) for x in rows]
    l1 = np.full((1 << BITS) + 1, L1)
    l1[-1] = 0.0  # the bias

    def weights(i):
        zi, ni = z[i], n[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1[i], 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i, label in zip(own, y, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - label
            was = n[i]
            now = was + g * g
            z[i] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[i] = now
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1]).astype(np.int32)
    return ToxicityModel(index, w[index].astype(np.float32), float(w[-1]))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [np.unique(grams(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32())), batch.column("y")], names=["doc_id", "x", "y"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, y = [], []
    for batch in batches:
        x = batch.column("x")
        ends, values = x.offsets.to_numpy(), x.values.to_numpy()
        rows += [values[a:b].copy() for a, b in zip(ends, ends[1:], strict=False)]
        y += batch.column("y").to_pylist()
    model = fit(rows, y)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(model.index, -1), pa.int32()), pa.array(np.append(model.weight.astype(float), model.bias), pa.float64())], names=["i", "w"]
    )


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicityModel:
    """Learn from a bounded sample of labelled ids outside the held-out fold, one row of each.

    The sample's n-grams are hashed where the texts are. FTRL takes documents one after another, so one task
    learns from the hashed rows of the sample, in the order of hashed ids; its size is bounded by `bound`.
    """
    sample = one_each(labelled_sample(docs, labels, label, bound).mapInArrow(_grams, "doc_id long, x array<int>, y int"))
    learnt = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(_learn, "i int, w double").toArrow()
    i, w = learnt["i"].to_numpy(), learnt["w"].to_numpy()
    if not (i == -1).any():
        return fit([], [])
    return ToxicityModel(i[i >= 0], w[i >= 0].astype(np.float32), float(w[i == -1][0]))


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    table = model.dense()
    for batch in sliced(batches):
        s = [model.score(grams(t or ""), table) for t in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=names)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the toxicity of each whole text, 0 to 1.

    The text alone decides; a null or empty text has no n-grams and gets the score of the bias. Equal texts
    score alike. A column with the name asked for is replaced; all others pass through. One narrow stage.
    """
    kept = docs.select([c for c in docs.columns if c.lower() != out.lower() or c == text])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    return kept.mapInArrow(partial(_score, model=model, text=text, names=schema.names), schema)
