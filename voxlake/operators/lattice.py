"""The cheapest path through pitch candidates, frame after frame, with what is decided given out early.

A frame's candidates are a few periods and the choice that it has none. The recursion is one small matrix of costs for
each frame, so all matrices of a batch are made at once; back-pointers are rows of bytes. When all paths that are still
open go through one candidate of an earlier frame, everything up to there is decided and leaves the state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LN2 = math.log(2.0)
#: Frames after which open paths are looked through.
CHECK = 64


@dataclass(frozen=True)
class Costs:
    """Weights of the path: of a change of period for each frame, of an octave, of entering or leaving voice."""

    lag: float
    change: float
    octave: float
    switch: float
    spectrum: float
    loudness: float
    voice_bias: float


@dataclass
class Candidates:
    """Frames from `first` on: periods (k wide; NaN after the last), places and heights of the same width, and one number a frame for the rest."""

    frame: np.ndarray
    lags: np.ndarray
    places: np.ndarray
    peaks: np.ndarray
    top: np.ndarray
    stationarity: np.ndarray
    rms_ratio: np.ndarray
    rms: np.ndarray


@dataclass
class Lattice:
    """The open end of one utterance's paths.

    `costs` are the best costs of the last frame's candidates, the last of which is unvoiced; `back` the back-pointers of
    frames that are not decided, `held` their (frame, place, peak) and `rms`. With a `limit`, at most so many frames stay
    open: then the cheapest path is taken as it is.
    """

    weights: Costs
    limit: int | None = None
    lags: np.ndarray | None = None
    costs: np.ndarray | None = None
    back: list[np.ndarray] = field(default_factory=list)
    held: list[tuple] = field(default_factory=list)

    def _moves(self, lags: np.ndarray, before: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Costs from each candidate of the frame before (last axis) to each of a frame's; the last candidate is unvoiced."""
        n, k = lags.shape
        out = np.zeros((n, k + 1, before.shape[1] + 1))
        change = np.log(lags[:, :, None] / before[:, None, :])
        octave = self.weights.octave
        out[:, :-1, :-1] = self.weights.change * np.minimum(np.abs(change), octave + np.minimum(np.abs(change + LN2), np.abs(change - LN2)))
        out[:, :-1, -1] = enter[:, None]
        out[:, -1, :-1] = leave[:, None]
        absent = np.isnan(before)
        out[:, :, :-1][np.broadcast_to(absent[:, None, :], (n, k + 1, before.shape[1]))] = np.inf
        out[:, :-1][np.isnan(lags)] = 0  # what is absent costs too much by itself
        return out

    def step(self, own: Candidates) -> Iterator[tuple]:
        """(frame, place, peak, rms) of frames that are decided once `own` are known; an unvoiced frame's place is 0."""
        n = len(own.frame)
        if not n:
            return
        w = self.weights
        local = np.concatenate([1 - own.peaks * (1 - own.lags * w.lag), (w.voice_bias + own.top)[:, None]], axis=1)
        local[np.isnan(local)] = np.inf
        enter = w.switch + w.spectrum * own.stationarity + w.loudness / own.rms_ratio
        leave = w.switch + w.spectrum * own.stationarity + w.loudness * own.rms_ratio
        width = own.lags.shape[1]
        before = np.full((n, max(width, 0 if self.lags is None else len(self.lags))), np.nan)
        before[1:, :width] = own.lags[:-1]
        costs = None
        if self.costs is not None:
            before[0, : len(self.lags)] = self.lags
            costs = np.full(before.shape[1] + 1, np.inf)
            costs[: len(self.lags)], costs[-1] = self.costs[:-1], self.costs[-1]
        moves = self._moves(own.lags, before, enter, leave)
        rows = np.arange(width + 1)
        first = len(self.back)
        for t in range(n):
            if costs is None:
                came, costs = np.zeros(width + 1, np.int64), local[t]
            else:
                if len(costs) < moves.shape[2]:  # the frame before has fewer candidates than the matrix is wide
                    costs = np.concatenate([costs[:-1], np.full(moves.shape[2] - len(costs), np.inf), costs[-1:]])
                total = moves[t] + costs
                came = total.argmin(1)
                costs = total[rows, came] + local[t]
                came = np.where(came == moves.shape[2] - 1, -1, came)
            self.back.append(came.astype(np.int8))
        self.lags, self.costs = own.lags[-1], costs
        self.held.extend(zip(own.frame.tolist(), own.places, own.peaks, own.top.tolist(), own.rms.tolist(), strict=True))
        if first + n >= CHECK or self.limit is not None:
            yield from self._decided()

    def _decided(self) -> Iterator[tuple]:
        """Frames before the last one at which all open paths meet; with a limit, all frames if too many are open."""
        open_paths = np.unique(np.append(np.flatnonzero(np.isfinite(self.costs[:-1])), -1))
        for t in range(len(self.back) - 1, 0, -1):
            open_paths = np.unique(self.back[t][open_paths])
            if len(open_paths) == 1:
                yield from self._leave(t, int(open_paths[0]))
                return
        if self.limit is not None and len(self.back) >= self.limit:
            yield from self._leave(len(self.back), self._best())

    def _best(self) -> int:
        k = int(self.costs.argmin())
        return -1 if k == len(self.costs) - 1 else k

    def _leave(self, count: int, at: int) -> list[tuple]:
        """The first `count` held frames along the path that goes through candidate `at` of the last of them."""
        out = []
        for t in range(count - 1, -1, -1):
            frame, places, peaks, top, rms = self.held[t]
            out.append((frame, 0.0, top, rms) if at < 0 else (frame, float(places[at]), float(peaks[at]), rms))
            at = int(self.back[t][at])
        del self.held[:count], self.back[:count]
        return out[::-1]

    def finish(self) -> list[tuple]:
        """All frames that are still open, along the cheapest path."""
        return self._leave(len(self.back), self._best()) if self.back else []
