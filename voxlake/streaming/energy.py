"""The energy detector over a stream of frames, with its floor, history and window of labels as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sad import EnergyState, Majority, odd

STATE = "seen long, floor double, level double, gaps int, jumped long, history array<double>, labels long, decided array<int>, raw array<int>, waiting array<long>"


def energy_sad_stream(frames: DataFrame, least: float, threshold: float, median: int = 1) -> DataFrame:
    """(utt, frame, sad) of a stream (utt, frame, energy) whose frames arrive in order.

    An utterance's state is five numbers, ten history slots and a window of `median` labels, whatever its length; the
    labels are those of the batch operator. A label waits for half a window of frames after it. A row whose
    `last` is true (if there is such a column) ends its utterance: the rest comes out and the state goes.
    """
    ended = "last" in frames.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, majority, waiting = EnergyState(), Majority(odd(max(median, 1))), []
        if state.exists:
            *numbers, history, labels, decided, raw, waiting = state.get
            own = EnergyState(*numbers, list(history))
            majority = Majority(majority.length, labels, list(decided), list(raw))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("frame")
        waiting = [*waiting, *pdf["frame"].tolist()]
        found = [majority.push(own.step(e, least, threshold)) for e in pdf["energy"]]
        sad = [label for label in found if label is not None]
        if ended and bool(pdf["last"].iloc[-1]):
            sad += majority.finish()
            if state.exists:
                state.remove()
        else:
            left = [int(v) for v in waiting[len(sad) :]]
            state.update((own.seen, float(own.floor), float(own.level), own.gaps, own.jumped, [float(v) for v in own.history], majority.seen, majority.decided, majority.raw, left))
        yield pd.DataFrame({"utt": [key[0]] * len(sad), "frame": waiting[: len(sad)], "sad": sad}).astype({"utt": "int64", "frame": "int64", "sad": "int32"})

    return frames.groupBy("utt").applyInPandasWithState(run, "utt long, frame long, sad int", STATE, "append", GroupStateTimeout.NoTimeout)
