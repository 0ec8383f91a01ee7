"""Recipes from a configuration: cepstra, speech activity and blocks of features in one go, and supervectors.

A configuration is a dictionary or its JSON text; numbers and booleans may be text, as in `{"num_cep": "19"}`.
Every recipe is a chain of the operators beside it, so its steps are planned together.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, get_type_hints

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import embed, gmm, intervals, sad
from .features import BLOCKS, apply_sad, difference, normalise, rasta, regression, select_features, shifted_deltas
from .gmm import Mixture
from .spectral import SpectralConfig, cepstra

#: The usual settings for speakers, and what those for languages have else.
SPEAKER = {"feat_type": "mfcc", "alpha": 1, "dither": 1, "fb_low": 300, "fb_hi": 3140, "keep_c0": False, "linear": False, "num_cep": 19, "win_inc_ms": 10, "win_len_ms": 20}
LANGUAGE = SPEAKER | {"keep_c0": True, "num_cep": 6}
#: Settings of cepstra that have no default.
REQUIRED = ("alpha", "dither", "fb_low", "fb_hi", "keep_c0", "linear", "num_cep", "win_inc_ms", "win_len_ms")

#: Labels (utt, frame, sad) of frames, from the signal and its features.
Speech = Callable[[DataFrame, DataFrame], DataFrame]


def loaded(config: dict | str) -> dict:
    out = json.loads(config) if isinstance(config, str) else config
    if not isinstance(out, dict):
        raise ValueError("a configuration is a dictionary or its JSON text")
    return out


def flag(value: Any) -> bool:
    """True or false, also as text or as 1 or 0."""
    text = str(value).strip().lower()
    if text not in ("true", "false", "1", "0"):
        raise ValueError(f"{value!r} is neither true nor false")
    return text in ("true", "1")


def number(value: Any, kind: type = float) -> Any:
    out = float(value)
    if kind is int and out != int(out):
        raise ValueError(f"{value!r} is not a whole number")
    return kind(out)


def needed(config: dict, name: str) -> Any:
    if name not in config:
        raise ValueError(f"the configuration lacks {name}")
    return config[name]


def spectral_config(config: dict | str, sample_rate: float = 8000.0) -> SpectralConfig:
    """Settings of cepstra; a missing required one is an error, names that are not settings are passed over."""
    own = loaded(config)
    if own.get("feat_type", "mfcc") != "mfcc":
        raise ValueError("only cepstra are known")
    for name in REQUIRED:
        needed(own, name)
    kinds = {n: k for n, k in get_type_hints(SpectralConfig).items() if n in own and n != "sample_rate"}
    return SpectralConfig(sample_rate=sample_rate, **{n: flag(own[n]) if k is bool else number(own[n], k) for n, k in kinds.items()})


def by_energy(config: dict | str) -> Speech:
    """Speech by the energy detector: `abs_min_energy`, `thresh` and, if wanted, `med_len`."""
    own = loaded(config)
    least, threshold, median = number(needed(own, "abs_min_energy")), number(needed(own, "thresh")), number(own.get("med_len", 1), int)
    return lambda signal, frames: sad.energy_sad(frames.select("utt", "frame", "energy"), least, threshold, median)


def speech_intervals(signal: DataFrame, config: dict | str, models: dict[str, Mixture], sample_rate: float = 8000.0) -> DataFrame:
    """(utt, start, stop) in frames, where the model `label_keep` is the best of all.

    Cepstra are band-passed along time and get slopes; each model scores each frame by itself. Scores are
    smoothed over `label_window` frames, runs of the best model become intervals, gaps below `min_gap_dur`
    seconds are closed and intervals below `min_seg_dur` dropped.
    """
    own = loaded(config)
    features = spectral_config(needed(own, "feat_config"), sample_rate)
    keep = list(models).index(needed(own, "label_keep"))
    frames = select_features(regression(rasta(cepstra(signal, features)), 2), "fd")
    scores = gmm.class_scores(frames.select("utt", "frame", F.col("features").alias("base")), list(models.values()))
    best = sad.best_model(sad.smooth_scores(scores, number(own.get("label_window", 50), int)))
    kept = intervals.runs(best).where(F.col("label") == keep)
    in_frames = lambda name, default: round(number(own.get(name, default)) * 1000 / features.win_inc_ms, 9)
    return intervals.merged(kept, in_frames("min_gap_dur", 0.5), in_frames("min_seg_dur", 0.2))


def by_mixtures(config: dict | str, models: dict[str, Mixture], sample_rate: float = 8000.0) -> Speech:
    """Speech by mixtures, see `speech_intervals`."""

    def labels(signal: DataFrame, frames: DataFrame) -> DataFrame:
        found = speech_intervals(signal, config, models, sample_rate)
        return found.select("utt", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("frame"), F.lit(1).alias("sad"))

    return labels


def feature_pipe(signal: DataFrame, config: dict | str, speech: Speech | None = None, sample_rate: float = 8000.0) -> DataFrame:
    """Feature frames by `pipe_config`: cepstra, RASTA, slopes, accelerations, shifted deltas, speech frames only, normalisation, selection.

    A step is done if its `do_` entry is true. Without `speech` all frames stay. `features` holds the blocks
    that `outfeat` names; without it the blocks stay columns. Utterances without speech have no rows.
    """
    pipe = loaded(needed(loaded(config), "pipe_config"))
    on = lambda name: flag(pipe.get(name, False))
    frames = cepstra(signal, spectral_config(needed(pipe, "feat_config"), sample_rate))
    if on("do_rasta"):
        frames = rasta(frames)
    if on("do_delta"):
        frames = (difference if on("delta2point") else regression)(frames, number(needed(pipe, "delta_spread"), int))
    if on("do_accel"):
        frames = regression(frames, number(needed(pipe, "accel_spread"), int), "delta", "accel")
    if on("do_sdc"):
        spacing, blocks = needed(pipe, "sdc_params")
        frames = shifted_deltas(frames, number(spacing, int), number(blocks, int))
    if speech is not None:
        labels = speech(signal, frames).select("utt", "frame", "sad")
        frames = apply_sad(frames.join(labels.where("sad = 1"), ["utt", "frame"]))
    if on("do_feat_norm"):
        frames = normalise(frames, *[b for k, b in BLOCKS.items() if k != "e" and b in frames.columns])
    return select_features(frames, pipe["outfeat"]) if "outfeat" in pipe else frames


def as_base(frames: DataFrame) -> DataFrame:
    """Selected features as the block that mixtures score."""
    return frames.select("utt", "frame", F.col("features").alias("base"))


def supervectors(frames: DataFrame, config: dict | str, model: Mixture, projection: np.ndarray | None = None) -> DataFrame:
    """(utt, vec) of frames (utt, frame, base): relevance `rf`; with `do_nap` the first `corank` rows of the projection are taken out."""
    own = loaded(config)
    relevance, statistics = number(needed(own, "rf")), gmm.sufficient_statistics(frames, model)
    if not flag(own.get("do_nap", False)):
        return embed.supervector(statistics, model, relevance)
    corank = number(needed(own, "corank"), int)
    if projection is None:
        raise ValueError("taking directions out needs a projection")
    return embed.supervector_without(statistics, model, relevance, projection, corank)
