"""Pitch of a stream of frames: the open end of each utterance's paths is keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lattice import Lattice
from ..operators.pitch import FOUND, PitchConfig, Search, candidates_of

STATE = "lags array<double>, costs array<double>, back array<array<int>>, frame array<long>, places array<array<double>>, peaks array<array<double>>, top array<double>, rms array<double>"
#: Seconds for which frames may stay undecided.
LIMIT = 1.0


def saved(lattice: Lattice) -> tuple:
    held = list(zip(*lattice.held, strict=True)) or [(), (), (), (), ()]
    lists = lambda rows: [[float(v) for v in r] for r in rows]
    return (
        [float(v) for v in lattice.lags], [float(v) for v in lattice.costs], [[int(v) for v in r] for r in lattice.back],
        [int(v) for v in held[0]], lists(held[1]), lists(held[2]), [float(v) for v in held[3]], [float(v) for v in held[4]],
    )


def restored(lattice: Lattice, state: tuple) -> Lattice:
    lags, costs, back, frame, places, peaks, top, rms = state
    lattice.lags, lattice.costs = np.array(lags, float), np.array(costs, float)
    lattice.back = [np.array(r, np.int8) for r in back]
    lattice.held = list(zip(frame, [np.array(r, float) for r in places], [np.array(r, float) for r in peaks], top, rms, strict=True))
    return lattice


def pitch_stream(frames: DataFrame, rate: float, config: PitchConfig = PitchConfig(), limit: float = LIMIT, idle_ms: int | None = None) -> DataFrame:
    """(utt, frame, f0, peak, rms) of a stream (utt, frame, x) whose frames arrive in order; x as `candidates_of` takes it.

    Frames come out once all open paths agree on them, so they are those of the batch. After `limit` seconds without
    that the cheapest path is taken, so an utterance's state is that many frames at most. A row whose `last` is true (if there
    is such a column) ends its utterance, as does a pause of `idle_ms` between frames: what is open comes out and the state goes.
    """
    plan = Search(rate, config)
    ended = "last" in frames.columns
    found = candidates_of(frames, plan)
    most = max(1, round(limit / (plan.step / rate)))
    columns = ["frame", *(part.split()[0] for part in FOUND.split(", "))]

    def rows(key: tuple, decided: list[tuple]) -> pd.DataFrame:
        frame, place, peak, rms = zip(*decided, strict=True) if decided else ((), (), (), ())
        f0 = [rate / p if p else 0.0 for p in place]
        return pd.DataFrame({"utt": [key[0]] * len(decided), "frame": list(frame), "f0": f0, "peak": list(peak), "rms": list(rms)})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from ..operators.pitch import _block

        lattice = Lattice(plan.costs, most)
        if state.exists:
            lattice = restored(lattice, state.get)
        if state.hasTimedOut:
            state.remove()
            yield rows(key, lattice.finish())
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("frame")
        decided = []
        for start in range(0, len(pdf), most):
            part = pdf.iloc[start : start + most]
            batch = pa.RecordBatch.from_pandas(part[columns], preserve_index=False)
            decided += lattice.step(_block(batch))
        if ended and bool(pdf["last"].iloc[-1]):
            if state.exists:
                state.remove()
            yield rows(key, decided + lattice.finish())
            return
        state.update(saved(lattice))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows(key, decided)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return found.groupBy("utt").applyInPandasWithState(run, "utt long, frame long, f0 double, peak double, rms double", STATE, "append", timeout)
