"""Speech activity: labels from energy or model scores, and marks in seconds."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import over, own_rows, with_halo

#: Fixed values of the energy detector: history slots, frames before they count, rise of the floor a frame, decay, largest jump, patience.
HISTORY, ADAPT, RISE, DECAY, JUMP, PATIENCE = 10, 500, 0.002166062, 0.9, 100.0, 20


@dataclass
class EnergyState:
    """What the detector carries from frame to frame of one utterance; the stream keeps it as its state."""

    seen: int = 0
    floor: float = 0.0
    level: float = 0.0
    gaps: int = 0
    jumped: int = 0
    history: list[float] = field(default_factory=list)

    def step(self, energy: float, least: float, threshold: float) -> int:
        """1 if the frame is active.

        Every frame counts, but one below `least` changes nothing. From frame `ADAPT` on, a floor that has jumped
        from what it was `HISTORY` frames before goes back to that, until it has done so in `PATIENCE` frames
        running: then the new level is taken for good.
        """
        now = self.seen
        self.seen += 1
        if energy < least:
            return 0
        if not self.history:
            self.floor = self.level = energy
            self.history = [energy] * HISTORY
        self.level = DECAY * self.level + (1 - DECAY) * energy
        floor, slot = min(self.floor, self.level), now % HISTORY
        if now >= ADAPT and abs(floor - self.history[slot]) > JUMP:
            self.gaps = self.gaps + 1 if now - self.jumped == 1 else 0
            self.jumped = now
            if self.gaps < PATIENCE:
                floor = self.history[slot]
        self.history[slot] = floor
        self.floor = floor + RISE
        return int(energy - floor > threshold)


def smoothed(raw: np.ndarray, length: int) -> np.ndarray:
    """Recursive majority over an odd number of labels: decided ones before, raw ones from here on."""
    length += 1 - length % 2
    half = length // 2
    out, padded = raw.astype(int).copy(), np.append(raw.astype(int), [raw[-1] if len(raw) else 0] * half)
    ahead = np.concatenate([[0], np.cumsum(padded)])
    decided = int(out[:half].sum())
    for m in range(half, len(raw)):
        out[m] = int(decided + ahead[m + half + 1] - ahead[m] > half)
        decided += out[m] - out[m - half]
    return out


@dataclass
class Majority:
    """The recursive majority of `smoothed`, label after label: it holds decided labels before the next one, and raw ones from it on.

    A label comes out once half a window of raw ones after it is known; at the end the last raw one is repeated.
    """

    length: int
    seen: int = 0
    decided: list[int] = field(default_factory=list)
    raw: list[int] = field(default_factory=list)

    @property
    def half(self) -> int:
        return self.length // 2

    def push(self, label: int) -> int | None:
        """The oldest undecided label, if it can be told now."""
        self.seen += 1
        if self.half == 0:
            return label
        if self.seen <= self.half:
            self.decided.append(label)
            return label
        self.raw.append(label)
        return self._decide() if len(self.raw) > self.half else None

    def _decide(self) -> int:
        out = int(sum(self.decided) + sum(self.raw) > self.half)
        self.raw.pop(0)
        self.decided = [*self.decided[1:], out]
        return out

    def finish(self) -> list[int]:
        """The labels that are still undecided."""
        out, last = [], self.raw[-1] if self.raw else 0
        for _ in range(len(self.raw)):
            self.raw += [last] * (self.half + 1 - len(self.raw))
            out.append(self._decide())
        self.raw = []
        return out


def odd(length: int) -> int:
    return length + 1 - length % 2


def _labelled(batches: Iterator[pa.RecordBatch], least: float, threshold: float, median: int) -> Iterator[pa.RecordBatch]:
    utt = state = majority = None
    waiting: deque[int] = deque()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["utt", "frame", "sad"])

    for batch in batches:
        rows = []
        for u, frame, e in zip(*(batch.column(c).to_pylist() for c in ("utt", "frame", "energy")), strict=True):
            if state is None or u != utt:
                if majority is not None:
                    rows += [(utt, waiting.popleft(), label) for label in majority.finish()]
                utt, state, majority = u, EnergyState(), Majority(odd(max(median, 1)))
            waiting.append(frame)
            label = majority.push(state.step(e, least, threshold))
            if label is not None:
                rows.append((u, waiting.popleft(), label))
        yield packed(rows)
    if majority is not None:
        yield packed([(utt, waiting.popleft(), label) for label in majority.finish()])


def energy_sad(frames: DataFrame, least: float, threshold: float, median: int = 1) -> DataFrame:
    """(utt, frame, sad) of (utt, frame, energy): the floor follows the energy, so an utterance's frames are taken in order.

    They pass through a task as a stream, with fifteen numbers of state and a window of `median` labels for their
    recursive majority, so no task holds an utterance.
    """
    own = frames.select(F.col("utt").cast("long").alias("utt"), F.col("frame").cast("long").alias("frame"), F.col("energy").cast("double").alias("energy"))
    own = own.repartition("utt").sortWithinPartitions("utt", "frame")
    return own.mapInArrow(partial(_labelled, least=least, threshold=threshold, median=median), "utt long, frame long, sad int")


def marks_to_frames(marks: DataFrame, step_ms: float, lengths: DataFrame, round_duration: bool = False) -> DataFrame:
    """(utt, frame, sad) of marks (utt, start_s, dur_s): start and end are rounded to frames, or start and duration.

    A frame is speech if any mark holds it. Marks become their frames, so there is no comparison of every
    mark with every frame.
    """
    a = F.floor(F.col("start_s") * 1000 / step_ms + 0.5)
    length = F.floor(F.col("dur_s") * 1000 / step_ms + 0.5)
    stop = a + length if round_duration else F.floor((F.col("start_s") + F.col("dur_s")) * 1000 / step_ms + 0.5)
    held = marks.select("utt", a.cast("long").alias("a"), stop.cast("long").alias("b")).where("b >= a")
    speech = held.select("utt", F.explode(F.sequence("a", "b")).alias("frame")).distinct().withColumn("sad", F.lit(1))
    grid = lengths.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return grid.join(speech, ["utt", "frame"], "left").select("utt", "frame", F.coalesce("sad", F.lit(0)).alias("sad"))


def labels_for(lengths: DataFrame, labels: DataFrame, sloppy: bool = False) -> DataFrame:
    """Labels (utt, frame, sad) fitted to n frames each: `sloppy` cuts or pads with 0, else a different length is an error."""
    n = labels.groupBy("utt").agg(F.count(F.lit(1)).alias("have"))
    fitted = lengths.join(n, "utt", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    if not sloppy:
        fitted = fitted.withColumn("n", F.when(F.col("have") == F.col("n"), F.col("n")).otherwise(F.raise_error("label and frame counts differ").cast("long")))
    grid = fitted.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return grid.join(labels, ["utt", "frame"], "left").select("utt", "frame", F.coalesce("sad", F.lit(0)).alias("sad"))


def and_user_marks(frames: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Labels kept only in blocks of `width` frames that the user's string (utt, marks) marks S or s; beyond it nothing is kept."""
    kept = blocks.select("utt", F.posexplode(F.split("marks", "")).alias("block", "mark")).where("upper(mark) = 'S'").select("utt", "block")
    own = frames.withColumn("block", F.floor(F.col("frame") / width).cast("int"))
    return own.join(kept.withColumn("keep", F.lit(True)), ["utt", "block"], "left").select("utt", "frame", F.when(F.col("keep"), F.col("sad")).otherwise(0).alias("sad"))


def smooth_scores(scores: DataFrame, length: int) -> DataFrame:
    """(utt, frame, model, score): the running mean of `length` frames less the mean over models.

    The window is half before and half after; frames near the ends take the first or last whole window's
    value, and utterances shorter than it stay as they are.
    """
    half = length // 2
    before = half - (1 - length % 2)
    near = with_halo(scores, "frame", before, half)
    w = over("frame", "utt", "model").rowsBetween(-before, half)
    full = F.count(F.lit(1)).over(w) == before + half + 1
    means = own_rows(near.withColumn("mean", F.when(full, F.avg("score").over(w))))
    ends = means.where("mean is not null").groupBy("utt", "model").agg(F.min_by("mean", "frame").alias("head"), F.max_by("mean", "frame").alias("tail"), F.min("frame").alias("from"))
    filled = means.join(ends, ["utt", "model"], "left")
    value = F.when(F.col("from").isNull(), F.col("score")).otherwise(F.coalesce("mean", F.when(F.col("frame") < F.col("from"), F.col("head")).otherwise(F.col("tail"))))
    filled = filled.select("utt", "frame", "model", value.alias("score"), F.col("from").isNull().alias("short"))
    level = filled.groupBy("utt", "frame").agg(F.avg("score").alias("level"))
    return filled.join(level, ["utt", "frame"]).select("utt", "frame", "model", F.when(F.col("short"), F.col("score")).otherwise(F.col("score") - F.col("level")).alias("score"))


def best_model(scores: DataFrame) -> DataFrame:
    """(utt, frame, label): the model with the highest score, the lowest of equals."""
    best = F.max(F.struct("score", (-F.col("model")).alias("m"))).alias("b")
    return scores.groupBy("utt", "frame").agg(best).select("utt", "frame", (-F.col("b.m")).alias("label"))


def marks_text(intervals: DataFrame, step_ms: float, tag: Column) -> DataFrame:
    """(utt, line): `tag start duration` in seconds with two decimals, of intervals in frames."""
    s = step_ms / 1000
    line = F.format_string("%s %.2f %.2f", tag, F.col("start") * s, (F.col("stop") - F.col("start")) * s)
    return intervals.select("utt", "start", line.alias("line"))


def no_speech(frames: DataFrame) -> DataFrame:
    return frames.groupBy("utt").agg((F.max("sad") == 0).alias("no_speech"))


def speech_string(frames: DataFrame, width: int) -> DataFrame:
    """(utt, chunk, marks): 's' or 'n' for each frame, as strings of `width` frames, so no row holds an utterance."""
    rows = frames.withColumn("chunk", F.floor(F.col("frame") / width)).groupBy("utt", "chunk").agg(F.array_sort(F.collect_list(F.struct("frame", "sad"))).alias("s"))
    return rows.select("utt", "chunk", F.array_join(F.transform("s", lambda x: F.when(x["sad"] == 1, "s").otherwise("n")), "").alias("marks"))
