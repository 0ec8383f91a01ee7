"""Quality scores learnt from preferences: a Bradley-Terry model over text features.

Each labelled good document is preferred to several labelled poor ones. The chance that i is preferred to j
is the logistic of s(i) - s(j), where s is linear in the features of a text, so the weights are fitted by
logistic loss on feature differences. The quantile of the training scores at the share of poor documents is
the threshold; the reported score is the logistic of a score's distance from it.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import labelled_sample, one_each, sliced

FEATURES = (
    "upper", "digit", "mark", "rare_mark", "bar", "inner_mark", "shout", "stop_per_word", "log_words",
    "word_length", "variety", "repeated_lines", "repeated_words", "long_words", "line_words", "top_word", "stutter",
)
#: Documented bounds of the training: labelled rows sampled, opponents of each, and steps of Newton's method.
SAMPLE = 20_000
OPPONENTS = 8
STEPS = 30
RIDGE = 1e-2

LETTER, UPPER, DIGIT, BLANK, STOP, USUAL, BAR, RARE = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, RARE, np.uint8)
    table[128:] = LETTER
    table[ord("a") : ord("z") + 1] = LETTER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    for chars, kind in ((" \t\n\r\x0b\x0c", BLANK), (".!?", STOP), (",;:'\"()-", USUAL), ("|<>{}[]=_/\\", BAR)):
        for c in chars:
            table[ord(c)] = kind
    return table


CLASSES = _classes()
INNER = re.compile(rb"[^\sA-Za-z0-9\x80-\xff]{2,}").findall


def features(text: str) -> list[float]:
    """Features of one whole text; all are 0 for one without words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=8).astype(float)
    solid, many = n.sum() - n[BLANK], len(words)
    letters = max(1.0, n[LETTER] + n[UPPER])
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        n[UPPER] / letters, n[DIGIT] / solid, (n[STOP] + n[USUAL]) / solid, n[RARE] / solid, n[BAR] / solid,
        len(INNER(data)) / many, data.count(b"!!") / many, n[STOP] / many, math.log(many),
        solid / many / 10, math.log(len(counts)) / math.log(many) if many > 1 else 1.0,
        1 - len(set(lines)) / len(lines), 1 - pairs / (many - 1) if many > 1 else 0.0,
        sum(len(w) > 20 for w in counts) / len(counts), math.log(many / len(lines)), max(counts.values()) / many,
        math.sqrt(sum(map(operator.eq, words, words[1:])) / many),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Weights over standardised features, and the threshold between poor and good scores."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 of rows of features; 0.5 is at the threshold."""
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6) @ np.array(self.weights) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_preferences(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Fit a Bradley-Terry model to rows of features and their 0/1 labels.

    Without rows of both labels there is no preference: every score is 0.5.
    """
    if not len(x) or len(set(y.tolist())) < 2:
        return QualityModel((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - mean) / scale, -6, 6)
    good, poor = z[y == 1], z[y == 0]
    most = max(len(good), len(poor))
    # Rounds of pairings: in round k the poor are shifted, so that all meet different opponents.
    rows = np.arange(most)
    d = np.concatenate([good[rows % len(good)] - poor[(rows + k * (most // OPPONENTS + 1)) % len(poor)] for k in range(OPPONENTS)])
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the poor one is preferred
        gradient = d.T @ p / len(d) - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    # The threshold is the quantile of the scores at the share of poor documents, midway between neighbours.
    s = np.sort(z @ w)
    k = min(max(1, len(poor)), len(s) - 1)
    return QualityModel(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float((s[k - 1] + s[k]) / 2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        x = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> QualityModel:
    """Learn from a bounded sample of labelled ids outside the held-out fold; only the features of one row of each reach the driver."""
    sample = labelled_sample(docs, labels, label, bound)
    rows = one_each(sample.mapInArrow(_features, "doc_id long, x array<double>, y int")).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_preferences(x[order], rows["y"].to_numpy()[order])


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        x = np.array([features(t or "") for t in batch.column(text).to_pylist()], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=names)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the quality of each whole text, 0 to 1.

    The text alone decides; a null or empty text has the features 0 and its score. Equal texts score alike.
    A column with the name asked for is replaced; all others pass through. One narrow stage, no shuffle.
    """
    kept = docs.select([c for c in docs.columns if c.lower() != out.lower() or c == text])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    return kept.mapInArrow(partial(_score, model=model, text=text, names=schema.names), schema)
