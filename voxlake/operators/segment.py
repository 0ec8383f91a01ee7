"""Change points and clusters by the Bayesian information criterion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SIZE

LAMBDA = 1e-6


def splits(signal: DataFrame, margin: int) -> DataFrame:
    """(utt, i, n, n1, t2, bic) of each split of a scalar signal, from running sums: the part before sample i and the rest.

    t2 is Hotelling's statistic, bic the gain of two Gaussians over one less the price of their parameters. Sums run
    in two levels, inside blocks and over the blocks' sums, so no window holds an utterance.
    """
    x = F.col("x")
    own = signal.select("utt", "i", "x", F.floor(F.col("i") / SIZE).alias("block"))
    sums = own.groupBy("utt", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(x * x).alias("q"))
    earlier, whole = Window.partitionBy("utt").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("utt")
    sums = sums.select(
        "utt", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "s", "q")], *[F.sum(c).over(whole).alias(c) for c in ("n", "s", "q")]
    )
    w = Window.partitionBy("utt", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.select(
        "utt", "block", "i", F.count(F.lit(1)).over(w).alias("n_in"), F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("s_in"), F.coalesce(F.sum(x * x).over(w), F.lit(0.0)).alias("q_in")
    )
    run = inside.join(sums, ["utt", "block"]).select("utt", "i", "n", "s", "q", *[(F.col(f"{c}_before") + F.col(f"{c}_in")).alias(f"{c}1") for c in ("n", "s", "q")])
    run = run.where((F.col("n1") >= margin) & (F.col("n") - F.col("n1") >= margin))
    var = lambda n, s, q: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)) + LAMBDA
    n, n1, s, s1, q, q1 = (F.col(c) for c in ("n", "n1", "s", "s1", "q", "q1"))
    n2, s2, q2 = n - n1, s - s1, q - q1
    gap = s1 / n1 - s2 / n2
    t2 = n1 * n2 / n * gap * gap / var(n, s, q)
    bic = (n * F.ln(var(n, s, q)) - n1 * F.ln(var(n1, s1, q1)) - n2 * F.ln(var(n2, s2, q2))) / 2 - F.ln(n)
    return run.select("utt", "i", "n", "n1", t2.alias("t2"), bic.alias("bic"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of vectors, which come in order: (utt, block, first, n, sums, products, x)."""
    key, held = None, []

    def row() -> pa.RecordBatch:
        frame, x = np.concatenate([f for f, _ in held]), np.concatenate([v for _, v in held])
        lists = {"sums": x.sum(0), "products": (x.T @ x).ravel(), "x": x.ravel()}
        numbers = {"utt": int(key[0]), "block": int(key[1]), "first": int(frame[0]), "n": len(x)}
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in numbers.items()} | {k: pa.array([v], pa.list_(pa.float64())) for k, v in lists.items()})

    for batch in batches:
        utt, block, frame = (batch.column(c).to_numpy() for c in ("utt", "block", "frame"))
        x = np.asarray(batch.column("base").flatten(), float).reshape(len(utt), -1) if len(utt) else None
        cuts = [0, *(np.flatnonzero((utt[1:] != utt[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(utt)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and key != (utt[a], block[a]):
                yield row()
                held = []
            key = utt[a], block[a]
            held.append((frame[a:b], x[a:b]))
    if held:
        yield row()


def _block_splits(batches: Iterator[pa.RecordBatch], margin: int) -> Iterator[pa.RecordBatch]:
    """T2 of each split in a block, by what is before the block (count, sums) and the whole (count, sums, products)."""
    for batch in batches:
        for row in batch.to_pylist():
            whole, before = np.array(row["whole"]), np.array(row["before"])
            d = len(before) - 1
            n, total, products = whole[0], whole[1 : 1 + d], whole[1 + d :].reshape(d, d)
            x = np.array(row["x"]).reshape(-1, d)
            n1 = before[0] + np.arange(len(x))
            sums = before[1:] + np.concatenate([np.zeros((1, d)), np.cumsum(x, axis=0)[:-1]])
            at = np.flatnonzero((n1 >= margin) & (n - n1 >= margin))
            if not len(at):
                continue
            inverse = inverted(products / n - np.outer(total / n, total / n))
            n1, sums = n1[at], sums[at]
            gap = sums / n1[:, None] - (total - sums) / (n - n1)[:, None]
            t2 = np.einsum("ij,ij->i", gap @ inverse, gap) * (n1 * (n - n1) / n)
            longs = [np.full(len(at), row["utt"]), row["first"] + at, np.full(len(at), int(n)), n1]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in longs), pa.array(t2)], names=["utt", "i", "n", "n1", "t2"])


def vector_splits(frames: DataFrame, margin: int, size: int = 4_096) -> DataFrame:
    """(utt, i, n, n1, t2): Hotelling's statistic of each split of an utterance's vectors, the part before frame i and the rest.

    Sums run in two levels, inside blocks of `size` frames and over the blocks' sums, so no task holds an utterance.
    """
    own = frames.select(F.col("utt").cast("long").alias("utt"), F.col("frame").cast("long").alias("frame"), F.col("base").cast("array<double>").alias("base"))
    own = own.withColumn("block", F.floor(F.col("frame") / size)).repartition("utt", "block").sortWithinPartitions("utt", "block", "frame")
    packed = own.mapInArrow(_blocks, "utt long, block long, first long, n long, sums array<double>, products array<double>, x array<double>")
    listed = lambda: F.array_sort(F.collect_list(F.struct("k", "v")))["v"]
    count = F.array(F.col("n").cast("double"))
    whole = packed.select("utt", F.posexplode(F.concat(count, "sums", "products")).alias("k", "v")).groupBy("utt", "k").agg(F.sum("v").alias("v"))
    whole = whole.groupBy("utt").agg(listed().alias("whole"))
    earlier = Window.partitionBy("utt", "k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = packed.select("utt", "block", F.posexplode(F.concat(count, "sums")).alias("k", "v"))
    before = before.withColumn("v", F.coalesce(F.sum("v").over(earlier), F.lit(0.0))).groupBy("utt", "block").agg(listed().alias("before"))
    rows = packed.select("utt", "block", "first", "x").join(before, ["utt", "block"]).join(whole, "utt")
    return rows.mapInArrow(partial(_block_splits, margin=margin), "utt long, i long, n long, n1 long, t2 double")


def best_split(found: DataFrame, by: str) -> DataFrame:
    """(utt, i, value): the first of the largest values."""
    best = found.groupBy("utt").agg(F.max(F.struct(F.col(by).alias("value"), (-F.col("i")).alias("i"))).alias("b"))
    return best.select("utt", (-F.col("b.i")).alias("i"), "b.value")


def log_det(c: np.ndarray) -> float:
    """Of a covariance; a singular one is lifted until it has one."""
    lift = LAMBDA
    while True:
        sign, value = np.linalg.slogdet(c + lift * np.eye(len(c)))
        if sign > 0 and np.isfinite(value):
            return float(value)
        lift *= 10


def delta_bic(a: tuple, b: tuple, weight: float) -> float:
    """Of two segments, given as count, sum and sum of outer products; below 0 they are alike."""

    def part(n, s, q):
        m = s / n
        return 0.5 * n * log_det(q / n - np.outer(m, m))

    n, s, q = (x + y for x, y in zip(a, b, strict=True))
    d = len(s)
    return part(n, s, q) - part(*a) - part(*b) - 0.5 * weight * (d + d * (d + 1) / 2) * np.log(n)


def _stats(x: np.ndarray) -> tuple:
    return len(x), x.sum(0), x.T @ x


@dataclass(frozen=True)
class ChangeRule:
    """How changes are searched: frames first looked at beyond the least segment, the longest and least segment, growth, weight and threshold of the criterion."""

    first: int = 100
    largest: int = 500
    smallest: int = 25
    growth: int = 50
    weight: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        if min(self.first, self.largest, self.smallest, self.growth) < 1:
            raise ValueError("the sizes of a change search must be positive")


class ChangeSearch:
    """The search along one stretch of frames, which come in parts; it holds only those since the last change.

    A window from the stretch's start (or the last change) ends `smallest` + `first` frames on, and grows. Its split with the
    largest T2, at least `smallest` frames in, is a change if the criterion exceeds the threshold; a window that
    would pass `largest` frames is cut there. No change is made that leaves fewer than `smallest` frames
    after it. Sums of vectors and of their products follow the window, so a frame is added to them once.
    """

    def __init__(self, rule: ChangeRule):
        self.rule, self.held, self.base = rule, None, 0
        self._restart(0)

    def _restart(self, start: int) -> None:
        """A new window from a position of the stretch."""
        if self.held is not None:
            self.held = self.held[start - self.base :]
        self.base, self.stop = start, start + self.rule.smallest + self.rule.first
        self.summed, self.sums, self.products = 0, None, None

    def push(self, frames: np.ndarray) -> list[int]:
        """Last frames of the segments that end, counted from the stretch's start, as far as the frames so far tell."""
        self.held = frames if self.held is None else np.concatenate([self.held, frames])
        return self._search(None)

    def finish(self) -> list[int]:
        return self._search(self.base + len(self.held) - 1) if self.held is not None else []

    def _grow(self, n: int) -> None:
        """Running sums of the window's first n vectors, and the sum of their products."""
        more = self.held[self.summed : n]
        run = np.cumsum(more, axis=0)
        if self.sums is None:
            self.sums, self.products = run, more.T @ more
        else:
            self.sums, self.products = np.concatenate([self.sums, self.sums[-1] + run]), self.products + more.T @ more
        self.summed = n

    def _best(self) -> int:
        """The window's split with the largest T2: the first part's last frame, from the window's start."""
        n = self.summed
        mean = self.sums[-1] / n
        inverse = inverted(self.products / n - np.outer(mean, mean))
        at = np.arange(self.rule.smallest, n - 1)
        before = self.sums[at]
        n1 = (at + 1.0)[:, None]
        gap = before / n1 - (self.sums[-1] - before) / (n - n1)
        return int(at[(np.einsum("ij,ij->i", gap @ inverse, gap) * (n1[:, 0] * (n - n1[:, 0]) / n)).argmax()])

    def _search(self, end: int | None) -> list[int]:
        """`end` is the stretch's last frame, once it is known; before that only windows are looked at that it can't touch."""
        rule, found = self.rule, []
        while True:
            known = self.base + len(self.held) - 1
            if end is None and known < self.stop + rule.growth + rule.smallest or end is not None and self.stop > end:
                return found
            self._grow(self.stop - self.base + 1)
            k = self._best()
            if end is not None and end - (self.base + k) < rule.smallest:
                self.stop = end + 1
                return found
            y = self.held[: self.summed]
            if delta_bic(_stats(y[: k + 1]), _stats(y[k + 1 :]), rule.weight) > rule.threshold:
                found.append(self.base + k)
                self._restart(self.base + k + 1)
                continue
            self.stop += rule.growth
            if self.stop - self.base + 1 > rule.largest:
                at = self.base + rule.largest
                if end is not None and end - at < rule.smallest:
                    self.stop = end + 1
                    return found
                found.append(at)
                self._restart(at + 1)


def inverted(c: np.ndarray) -> np.ndarray:
    """The inverse of a covariance with a little on its diagonal; of a singular one, with more."""
    lift = LAMBDA
    while True:
        try:
            np.linalg.cholesky(c + lift * np.eye(len(c)))
            return np.linalg.inv(c + lift * np.eye(len(c)))
        except np.linalg.LinAlgError:
            lift *= 10


def change_points(x: np.ndarray, rule: ChangeRule = ChangeRule()) -> list[int]:
    """The last frame of each segment of a stretch but the last one."""
    own = ChangeSearch(rule)
    return own.push(x) + own.finish() if len(x) else []


def _cut(batches: Iterator[pa.RecordBatch], rule: ChangeRule, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of stretches of frames that come in order; a stretch is what shares `keys`."""
    key = search = None
    at, seen, made = 0, 0, []

    def ended(found: list[int]) -> None:
        nonlocal at
        for k in found:
            made.append((*key, at, key_start + k + 1))
            at = key_start + k + 1

    key_start = 0
    for batch in batches:
        frames = batch.column("frame").to_numpy()
        base = batch.column("base")
        x = np.asarray(base.flatten(), float).reshape(len(frames), -1) if len(frames) else np.zeros((0, 0))
        columns = [batch.column(c).to_pylist() for c in keys]
        rows = list(zip(*columns, strict=True))
        cuts = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if search is None or rows[a] != key:
                if search is not None:
                    ended(search.finish())
                    made.append((*key, at, key_start + seen))
                key, search, key_start, seen = rows[a], ChangeSearch(rule), int(frames[a]), 0
                at = key_start
            for start in range(a, b, 1_000):
                part = x[start : min(b, start + 1_000)]
                seen += len(part)
                ended(search.push(part))
        if len(made) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made = []
    if search is not None:
        ended(search.finish())
        made.append((*key, at, key_start + seen))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def segment(frames: DataFrame, rule: ChangeRule = ChangeRule()) -> DataFrame:
    """(utt, start, stop): stretches of each utterance's consecutive frames between changes; see `ChangeSearch`.

    An utterance's frames pass through a task in order, and only those of the open window stay there.
    """
    own = frames.select(F.col("utt").cast("long").alias("utt"), F.col("frame").cast("long").alias("frame"), F.col("base").cast("array<double>").alias("base"))
    own = own.repartition("utt").sortWithinPartitions("utt", "frame")
    schema = pa.schema([("utt", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    return own.mapInArrow(partial(_cut, rule=rule, keys=["utt"], schema=schema), "utt long, start long, stop long")


#: Frames of a block by which intervals meet their frames.
PART = 128


def within(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each frame of `frames` with every interval (utt, start, stop, ...) of its utterance that holds it, with the columns of both.

    An interval is dealt to the blocks of frames that it touches, not to its frames. The join is one of sorted sides, whatever
    the planner makes of the intervals' size, as that is measured before they are dealt.
    """
    first, last = F.floor(F.col("start") / PART), F.floor((F.col("stop") - 1) / PART)
    dealt = intervals.where("stop > start").withColumn("_block", F.explode(F.sequence(first, last)))
    met = frames.withColumn("_block", F.floor(F.col("frame") / PART)).join(dealt.hint("merge"), ["utt", "_block"])
    return met.where("frame >= start and frame < stop").drop("_block")


def segment_intervals(frames: DataFrame, intervals: DataFrame, speech_only: bool = False, rule: ChangeRule = ChangeRule()) -> DataFrame:
    """(utt, start, stop, label): intervals (utt, start, stop, label) of frames, each cut at the changes inside it.

    With `speech_only` intervals with another label than `speech` stay whole; so do those of fewer than `smallest`
    frames, and those without frames. An interval's frames pass through a task in order.
    """
    own = intervals.select(F.col("utt").cast("long").alias("utt"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("label").cast("string").alias("label"))
    wanted = (F.col("stop") - F.col("start") >= rule.smallest) & (F.col("label").eqNullSafe("speech") if speech_only else F.lit(True))
    rows = within(frames.select("utt", "frame", F.col("base").cast("array<double>").alias("base")), own.where(wanted))
    keys = ["utt", "start", "stop", "label"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "frame")
    schema = pa.schema([("utt", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    cut = ordered.mapInArrow(partial(_cut, rule=rule, keys=keys, schema=schema), "utt long, start long, stop long, label string, first long, last long")
    # The interval's own ends hold, though frames at them may lack.
    inner = Window.partitionBy(*keys).orderBy("first")
    cut = cut.withColumn("number", F.row_number().over(inner)).withColumn("next", F.lead("first").over(inner))
    cut = cut.select("utt", F.when(F.col("number") == 1, F.col("start")).otherwise(F.col("first")).alias("start"), F.coalesce("next", "stop").alias("stop"), "label")
    found = rows.select("utt", "start", "stop").distinct()
    return own.join(found, ["utt", "start", "stop"], "left_anti").unionByName(cut)


#: Segments that one segment is compared with at a time.
BLOCK = 256


def agglomerated(n: np.ndarray, s: np.ndarray, q: np.ndarray, weight: float, threshold: float, fewest: int = 1, most: int | None = None) -> list[int]:
    """The first segment of each segment's cluster, by counts (k), sums (k, d) and sums of outer products (k, d, d).

    The two most alike are joined (the first of equals) until none are below the threshold, or `fewest` clusters
    are left; while there are more than `most`, they are joined whatever the threshold. A segment keeps
    only its best partner among those after it and is compared in blocks, so memory grows with segments.
    """
    if not len(n):
        return []
    n, s, q = n.copy(), s.copy(), q.copy()
    d = s.shape[1]

    def costs(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        m = s / n[:, None]
        c = q / n[:, None, None] - m[:, :, None] * m[:, None, :]
        sign, value = np.linalg.slogdet(c + LAMBDA * np.eye(d))
        for k in np.flatnonzero((sign <= 0) | ~np.isfinite(value)):
            value[k] = log_det(c[k])
        return 0.5 * n * value

    own = np.concatenate([costs(n[k : k + BLOCK], s[k : k + BLOCK], q[k : k + BLOCK]) for k in range(0, len(n), BLOCK)])
    of, alive = np.arange(len(n)), np.ones(len(n), bool)
    value, partner = np.full(len(n), np.inf), np.full(len(n), -1)

    def gains(a: int, c: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(c), BLOCK):
            b = c[k : k + BLOCK]
            both = n[a] + n[b]
            out.append(costs(both, s[a] + s[b], q[a] + q[b]) - own[a] - own[b] - 0.5 * weight * (d + d * (d + 1) / 2) * np.log(both))
        return np.concatenate(out) if out else np.zeros(0)

    def search(a: int) -> None:
        c = a + 1 + np.flatnonzero(alive[a + 1 :])
        found = gains(a, c)
        value[a], partner[a] = (found.min(), c[found.argmin()]) if len(c) else (np.inf, -1)

    for a in range(len(n)):
        search(a)
    while (left := int(alive.sum())) > max(fewest, 1):
        a = int(value.argmin())
        b = int(partner[a])
        if b < 0 or not (value[a] < threshold or (most is not None and left > most)):
            break
        n[a], s[a], q[a] = n[a] + n[b], s[a] + s[b], q[a] + q[b]
        own[a] = costs(n[a : a + 1], s[a : a + 1], q[a : a + 1])[0]
        alive[b], value[b] = False, np.inf
        of[of == b] = a
        lost = alive & ((partner == a) | (partner == b))
        lost[a] = True
        near = np.flatnonzero(alive[:a] & ~lost[:a])
        new = gains(a, near)
        better = (new < value[near]) | ((new == value[near]) & (a < partner[near]))
        value[near[better]], partner[near[better]] = new[better], a
        for c in np.flatnonzero(lost):
            search(int(c))
    return of.tolist()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(utt, start, stop, x): count, sums and sums of products of the frames of each segment in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("utt", "start", "stop")], 1)
        order = np.lexsort(keys.T[::-1])
        keys, x = keys[order], np.asarray(batch.column("base").flatten(), float).reshape(len(keys), -1)[order]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        made = [np.concatenate([[n], total, squares.ravel()]) for n, total, squares in (_stats(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(made[0])), pa.array(np.concatenate(made)))
        yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys[cuts[:-1]].T.copy()), lists], names=["utt", "start", "stop", "x"])


def _clusters(batches: Iterator[pa.RecordBatch], weight: float, threshold: float, fewest: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """(utt, start, stop, cluster) of parts of the segments' sums, which come in order of utterance and segment."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["utt", "start", "stop", "cluster"]

    def joined() -> np.ndarray:
        keys, x = (np.concatenate(c) for c in zip(*held, strict=True))
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        keys, x = keys[first], np.add.reduceat(x, first)
        d = int((-1 + np.sqrt(1 + 4 * (x.shape[1] - 1))) / 2)
        of = agglomerated(x[:, 0], x[:, 1 : 1 + d], x[:, 1 + d :].reshape(-1, d, d), weight, threshold, fewest, most)
        number = {k: n for n, k in enumerate(dict.fromkeys(of))}
        return np.column_stack([keys, [number[k] for k in of]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names[:3]], 1)
        x = np.asarray(batch.column("x").flatten(), float).reshape(len(keys), -1)
        cuts = [0, *(np.flatnonzero(keys[1:, 0] != keys[:-1, 0]) + 1).tolist(), len(keys)]
        made = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1][0][-1, 0] != keys[a, 0]:
                made.append(joined())
                held = []
            held.append((keys[a:b], x[a:b]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(made).T.copy()], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined().T.copy()], names=names)


def cluster(segments: DataFrame, frames: DataFrame, weight: float = 1.0, threshold: float = 0.0, fewest: int = 1, most: int | None = None) -> DataFrame:
    """(utt, start, stop, cluster): segments of each utterance, of which the two most alike are joined while they are alike enough.

    An utterance keeps `fewest` clusters at least and, if `most` is given, no more than that. A segment's statistics are summed
    where its frames are, a row for each batch; the joining sees segments, not frames. It compares all segments of an utterance
    in one task, which holds their statistics.
    """
    longs = lambda df: [F.col(c).cast("long").alias(c) for c in df.columns if c != "base"]
    frames, segments = frames.select("utt", "frame", "base"), segments.select("utt", "start", "stop")
    pairs = within(frames.select(*longs(frames), F.col("base").cast("array<double>").alias("base")), segments.select(longs(segments)))
    parts = pairs.select("utt", "start", "stop", "base").mapInArrow(_sums, "utt long, start long, stop long, x array<double>")
    # The sums are few bytes for their work, so the number of tasks isn't left to their size.
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.repartition(tasks, "utt").sortWithinPartitions("utt", "start", "stop")
    return ordered.mapInArrow(partial(_clusters, weight=weight, threshold=threshold, fewest=fewest, most=most), "utt long, start long, stop long, cluster long")


def pair_distances(stats: DataFrame, weight: float = 1.0) -> DataFrame:
    """(utt, a, b, bic) of scalar segments (utt, seg, n, s, q): delta-BIC of the segments of one utterance that follow each other within it."""
    left = stats.select("utt", F.col("seg").alias("a"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    right = stats.select("utt", F.col("seg").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    cost = lambda n, s, q: n / 2 * F.ln(F.greatest(q / n - s / n * s / n, F.lit(0.0)) + LAMBDA)
    n, s, q = F.col("n1") + F.col("n2"), F.col("s1") + F.col("s2"), F.col("q1") + F.col("q2")
    value = cost(n, s, q) - cost(F.col("n1"), F.col("s1"), F.col("q1")) - cost(F.col("n2"), F.col("s2"), F.col("q2")) - weight * F.ln(n)
    return left.join(right, "utt").where("a < b").select("utt", "a", "b", value.alias("bic"))


def summary(found: DataFrame, threshold: Column) -> DataFrame:
    """Count, mean and deviation of the criterion, and the share above the threshold."""
    return found.groupBy("utt").agg(
        F.count(F.lit(1)).alias("n"), F.avg("bic").alias("mean"), F.stddev_pop("bic").alias("deviation"), F.avg(F.when(F.col("bic") > threshold, 1.0).otherwise(0.0)).alias("share")
    )
