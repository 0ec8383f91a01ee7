"""Diagonal Gaussian mixtures over feature frames.

A model is small (mixtures x features) and is sent to the tasks; frames are scored in Arrow batches by one
matrix product each. Whatever is added over frames is added per batch first and then grouped by utterance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_2PI = float(np.log(2 * np.pi))
#: Dimensions after which a Gaussian may be left.
DIMENSIONS = 8


@dataclass(frozen=True)
class Mixture:
    """Log weights and log determinants of M Gaussians, their means and inverse variances (M x D)."""

    log_weight: np.ndarray
    log_det: np.ndarray
    mean: np.ndarray
    inv_var: np.ndarray

    @classmethod
    def of(cls, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> Mixture:
        var = np.maximum(var, 1e-6)
        return cls(np.log(weight), np.log(var).sum(1), mean, 1 / var)

    @property
    def sizes(self) -> tuple[int, int]:
        """Gaussians, and features of each."""
        return self.mean.shape

    def with_means(self, mean: np.ndarray) -> Mixture:
        return replace(self, mean=mean)

    def log_density(self, x: np.ndarray, constants: Mixture | None = None) -> np.ndarray:
        """Of each frame and Gaussian, weights included; `constants` lends its weights and determinants."""
        if x.shape[1] != self.mean.shape[1]:
            raise ValueError(f"frames have {x.shape[1]} features, the model {self.mean.shape[1]}")
        c = constants or self
        m = self.mean * self.inv_var
        far = (x * x) @ self.inv_var.T - 2 * x @ m.T + (self.mean * m).sum(1)
        return -0.5 * (c.log_det + x.shape[1] * LOG_2PI - 2 * c.log_weight + far)

    def log_density_of(self, x: np.ndarray, chosen: np.ndarray, constants: Mixture | None = None) -> np.ndarray:
        """As `log_density`, of the Gaussians chosen for each frame (frames x count) only."""
        c, out = constants or self, np.empty(chosen.shape)
        for a in range(0, len(x), 1024):
            k = chosen[a : a + 1024]
            far = ((x[a : a + 1024, None, :] - self.mean[k]) ** 2 * self.inv_var[k]).sum(2)
            out[a : a + 1024] = -0.5 * (c.log_det[k] + x.shape[1] * LOG_2PI - 2 * c.log_weight[k] + far)
        return out


    def log_density_within(self, x: np.ndarray, chosen: np.ndarray, shortfall: float, constants: Mixture | None = None) -> tuple[np.ndarray, int]:
        """As `log_density_of`, -inf for Gaussians whose exponent is over `shortfall` / 2 below the frame's best; and the terms that were not computed.

        A Gaussian's sum over dimensions only grows, so it is left as soon as it passes that of the first chosen one by
        the shortfall; what remains is compared with the best. So the order of those chosen changes nothing, and a
        frame's score loses ln(1 + (count - 1) exp(-shortfall / 2)) at most.
        """
        c, (n, count) = constants or self, chosen.shape
        value = c.log_det[chosen] + x.shape[1] * LOG_2PI - 2 * c.log_weight[chosen]
        first = chosen[:, 0]
        value[:, 0] += ((x - self.mean[first]) ** 2 * self.inv_var[first]).sum(1)
        row, at = np.nonzero(np.broadcast_to(np.arange(count) > 0, chosen.shape))
        skipped = 0
        for d in range(0, x.shape[1], DIMENSIONS):
            part = slice(d, d + DIMENSIONS)
            stays = value[row, at] <= value[row, 0] + shortfall
            skipped += int((~stays).sum()) * (x.shape[1] - d)
            value[row[~stays], at[~stays]] = np.inf
            row, at = row[stays], at[stays]
            k = chosen[row, at]
            value[row, at] += ((x[row, part] - self.mean[k, part]) ** 2 * self.inv_var[k, part]).sum(1)
        value[value > value.min(1, keepdims=True) + shortfall] = np.inf
        return -0.5 * value, skipped


def log_sum(q: np.ndarray) -> np.ndarray:
    top = q.max(1, keepdims=True)
    return (top + np.log(np.exp(q - top).sum(1, keepdims=True)))[:, 0]


def class_models(frames: DataFrame, key: str = "utt") -> DataFrame:
    """(mix, d, mean, var, log_w): a Gaussian for each class, by one grouped pass."""
    stats = frames.select(F.col(key).alias("mix"), F.posexplode("base").alias("d", "v")).groupBy("mix", "d").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count(F.lit(1)).alias("n"))
    total = stats.where("d = 0").agg(F.sum("n").alias("total"))
    return stats.crossJoin(F.broadcast(total)).select("mix", "d", "mean", F.greatest("var", F.lit(1e-6)).alias("var"), F.ln(F.col("n") / F.col("total")).alias("log_w"))


def gathered(models: DataFrame) -> Mixture:
    """The model table as one mixture; it has as many rows as the model has parameters."""
    rows = models.orderBy("mix", "d").toArrow()
    mixes = len(set(rows["mix"].to_pylist()))
    shaped = {n: rows[n].to_numpy().reshape(mixes, -1) for n in ("mean", "var", "log_w")}
    return Mixture.of(np.exp(shaped["log_w"][:, 0]), shaped["mean"], shaped["var"])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x, float).ravel()))


def _posteriors(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            q = model.log_density(_matrix(batch, "base"))
            total = log_sum(q)
            yield pa.RecordBatch.from_arrays([batch.column("utt"), batch.column("frame"), _lists(q), pa.array(total), _lists(np.exp(q - total[:, None]))], names=["utt", "frame", "q", "loglik", "posterior"])


def densities(frames: DataFrame, model: Mixture) -> DataFrame:
    """(utt, frame, q, loglik, posterior): log density of each Gaussian, of the mixture, and each Gaussian's share."""
    return frames.select("utt", "frame", "base").mapInArrow(partial(_posteriors, model=model), "utt long, frame long, q array<double>, loglik double, posterior array<double>")


def score(frames: DataFrame, model: Mixture) -> DataFrame:
    """(utt, score): mean log-likelihood of the frames."""
    return densities(frames, model).groupBy("utt").agg(F.avg("loglik").alias("score"))


def _each(batches: Iterator[pa.RecordBatch], models: list[Mixture]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, "base")
            scores = np.stack([log_sum(m.log_density(x)) for m in models], 1)
            yield pa.RecordBatch.from_arrays([batch.column("utt"), batch.column("frame"), _lists(scores)], names=["utt", "frame", "scores"])


def class_scores(frames: DataFrame, models: list[Mixture]) -> DataFrame:
    """(utt, frame, model, score): log-likelihood of each frame under each model by itself; models are numbered in their order."""
    rows = frames.select("utt", "frame", "base").mapInArrow(partial(_each, models=models), "utt long, frame long, scores array<double>")
    return rows.select("utt", "frame", F.posexplode("scores").alias("model", "score"))


def top_mixtures(frames: DataFrame, model: Mixture, count: int) -> DataFrame:
    """(utt, frame, rank, mix): the `count` densest Gaussians of each frame."""
    pairs = F.transform("q", lambda q, k: F.struct((-q).alias("q"), k.alias("mix")))
    best = densities(frames, model).select("utt", "frame", F.slice(F.array_sort(pairs), 1, count).alias("best"))
    return best.select("utt", "frame", F.posexplode("best").alias("rank", "b")).select("utt", "frame", "rank", "b.mix")


def _against(batches: Iterator[pa.RecordBatch], background: Mixture, targets: dict[str, Mixture], count: int, own_constants: bool, shortfall: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch, "base")
        q = background.log_density(x)
        best = np.argsort(-q, axis=1, kind="stable")[:, :count]
        names, scores, skipped = ["background"], [log_sum(np.take_along_axis(q, best, 1))], [0]
        for name, model in targets.items():
            names.append(name)
            lent, left = None if own_constants else background, 0
            if shortfall is None:
                own = model.log_density_of(x, best, lent)
            else:
                own, left = model.log_density_within(x, best, shortfall, lent)
            scores.append(log_sum(own))
            skipped.append(left)
        utt, at = np.unique(batch.column("utt").to_numpy(), return_inverse=True)
        sums = np.stack([np.bincount(at, s, len(utt)) for s in scores])
        n = np.bincount(at, minlength=len(utt))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(utt, len(names))), pa.array(np.repeat(names, len(utt)).tolist()), pa.array(sums.ravel()), pa.array(np.tile(n, len(names))), pa.array(np.repeat(np.array(skipped) / len(x), len(utt)) * np.tile(n, len(names)))], names=["utt", "model", "sum", "n", "skipped"])


def score_models(frames: DataFrame, background: Mixture, targets: dict[str, Mixture], count: int = 5, own_constants: bool = False, shortfall: float | None = None) -> DataFrame:
    """(utt, model, score): mean over frames under the background's `count` densest Gaussians and the same ones of each target.

    With a `shortfall` Gaussians that far below a frame's best are left out (see `Mixture.log_density_within`), and
    `skipped` is the share of a target's terms that were not computed, spread evenly over a batch's frames.
    """
    run = partial(_against, background=background, targets=targets, count=count, own_constants=own_constants, shortfall=shortfall)
    parts = frames.select("utt", "base").mapInArrow(run, "utt long, model string, sum double, n long, skipped double")
    share = (F.sum("skipped") / F.sum("n") / (count * background.mean.shape[1])).alias("skipped")
    return parts.groupBy("utt", "model").agg((F.sum("sum") / F.sum("n")).alias("score"), *([] if shortfall is None else [share]))


def _statistics(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch, "base")
        q = model.log_density(x)
        p = np.exp(q - log_sum(q)[:, None])
        utts = batch.column("utt").to_numpy()
        for utt in np.unique(utts):
            own = utts == utt
            first = np.concatenate([p[own].sum(0)[:, None], p[own].T @ x[own]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), utt)), pa.array(np.arange(len(first), dtype=np.int32)), _lists(first)], names=["utt", "mix", "s"])


def sufficient_statistics(frames: DataFrame, model: Mixture) -> DataFrame:
    """(utt, mix, ec, f): soft counts and sums of frames of each Gaussian, added per batch and then over batches."""
    parts = frames.select("utt", "base").mapInArrow(partial(_statistics, model=model), "utt long, mix int, s array<double>")
    sums = parts.select("utt", "mix", F.posexplode("s").alias("d", "v")).groupBy("utt", "mix", "d").agg(F.sum("v").alias("v"))
    packed = sums.groupBy("utt", "mix").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("s"))
    return packed.select("utt", "mix", F.get("s", F.lit(0)).alias("ec"), F.slice("s", F.lit(2), F.size("s") - 1).alias("f"))


def map_adapt(statistics: DataFrame, model: Mixture, relevance: float) -> DataFrame:
    """(utt, mix, ec, mean): means drawn toward the frames, the more of them the further."""
    prior = _table(statistics, model)
    own = statistics.join(F.broadcast(prior), "mix")
    mean = F.zip_with("mu", "f", lambda m, f: (m * relevance + f) / (F.col("ec") + relevance))
    return own.select("utt", "mix", "ec", mean.alias("mean"), "mu", "inv_var")


def _table(like: DataFrame, model: Mixture) -> DataFrame:
    rows = [(k, m.tolist(), v.tolist()) for k, (m, v) in enumerate(zip(model.mean, model.inv_var, strict=True))]
    return like.sparkSession.createDataFrame(rows, "mix int, mu array<double>, inv_var array<double>")


def decide(scores: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(utt, language, score): each language's first model less its second."""
    rows = [{"language": name, "model": m, "sign": sign} for name, both in pairs.items() for m, sign in zip(both, (1.0, -1.0), strict=True)]
    # As an Arrow table it needs no Python workers of its own.
    named = pa.schema([("language", pa.string()), ("model", pa.string()), ("sign", pa.float64())])
    table = scores.sparkSession.createDataFrame(pa.Table.from_pylist(rows, named))
    return scores.join(F.broadcast(table), "model").groupBy("utt", "language").agg(F.sum(F.col("score") * F.col("sign")).alias("score"))
