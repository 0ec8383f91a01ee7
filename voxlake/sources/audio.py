"""Audio files as tables: SPHERE, WAVE and headerless samples, one row for each file and channel.

Spark lists and reads the files; a task decodes one file at a time. `exploded` gives the rows that the
operators take.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import g711

SCHEMA = "path string, channel int, sample_rate int, coding string, samples array<int>"


def parse_sphere(data: bytes) -> tuple[int, str, np.ndarray]:
    """(rate, coding, samples x channels) of a NIST SPHERE file; companded samples stay bytes."""
    if not data.startswith(b"NIST_1A"):
        raise ValueError("not a SPHERE file")
    size = int(data[8:16])
    fields = dict(re.findall(rb"(\S+) -\w+ ([^\n]*)", data[:size]))
    number = lambda key, default: int(fields.get(key, default))
    rate, width, channels = number(b"sample_rate", 0), number(b"sample_n_bytes", 2), number(b"channel_count", 1)
    coding = fields.get(b"sample_coding", b"pcm").split(b",")[0].decode()
    if coding not in ("pcm", "ulaw", "alaw") or rate <= 0:
        raise ValueError(f"coding {coding} at {rate} Hz is not understood")
    kind = np.uint8 if coding != "pcm" or width == 1 else np.dtype(">i2" if fields.get(b"sample_byte_format") == b"10" else "<i2")
    body = np.frombuffer(data, kind, offset=size)
    return rate, coding, body[: len(body) // channels * channels].reshape(-1, channels).astype(np.int32)


def parse_wave(data: bytes) -> tuple[int, str, np.ndarray]:
    """(rate, coding, samples x channels) of a RIFF file with 16-bit PCM; its chunks may come in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at + 8 : at + 8 + size]
        form, body = (struct.unpack("<HHIIHH", chunk[:16]), body) if name == b"fmt " else (form, chunk) if name == b"data" else (form, body)
        at += 8 + size + size % 2
    if form is None or body is None or form[0] != 1 or form[5] != 16:
        raise ValueError("only 16-bit PCM is understood")
    x = np.frombuffer(body, "<i2", count=len(body) // 2)
    return form[2], "pcm", x[: len(x) // form[1] * form[1]].reshape(-1, form[1]).astype(np.int32)


def raw_parser(rate: int) -> Callable[[bytes], tuple[int, str, np.ndarray]]:
    """Headerless 16-bit samples of one channel."""
    if rate <= 0:
        raise ValueError("the sampling rate must be positive")

    def parse(data: bytes) -> tuple[int, str, np.ndarray]:
        if not data:
            raise ValueError("the file is empty")
        return rate, "pcm", np.frombuffer(data, "<i2", count=len(data) // 2).reshape(-1, 1).astype(np.int32)

    return parse


def read(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[int, str, np.ndarray]], sum_channels: bool = False) -> DataFrame:
    """(path, channel, sample_rate, coding, samples) of all files at a path; channels may be summed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rate, coding, x = parse(bytes(content))
                columns = [x.sum(1)] if sum_channels else list(x.T)
                yield pd.DataFrame({"path": name, "channel": range(len(columns)), "sample_rate": rate, "coding": coding, "samples": [c.tolist() for c in columns]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def exploded(audio: DataFrame) -> DataFrame:
    """(utt, i, x, sample_rate): one row for each sample, expanded from its companding. Blocks of a file tell by `first` where they are in it."""
    first = F.col("first") if "first" in audio.columns else F.lit(0)
    rows = audio.select(F.xxhash64("path", "channel").alias("utt"), "sample_rate", "coding", first.alias("first"), F.posexplode("samples").alias("i", "s"))
    x = F.when(F.col("coding") == "ulaw", g711.ulaw(F.col("s"))).when(F.col("coding") == "alaw", g711.alaw(F.col("s"))).otherwise(F.col("s"))
    return rows.select("utt", (F.col("first") + F.col("i")).cast("long").alias("i"), x.cast("double").alias("x"), "sample_rate")


def wave_bytes(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono RIFF file; samples are cut toward zero."""
    body = np.clip(np.trunc(x), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def encoded(signal: DataFrame, rate: int, wave: bool = True) -> DataFrame:
    """(utt, content): each utterance as the bytes of a file, to be written by any sink; a file is one utterance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["x"].to_numpy(float)
        rounded = np.sign(x) * np.floor(np.abs(x) + 0.5)
        content = wave_bytes(x, rate) if wave else np.clip(rounded, -32768, 32767).astype("<i2").tobytes()
        return pd.DataFrame({"utt": [pdf["utt"].iloc[0]], "content": [content]})

    return signal.select("utt", "i", "x").groupBy("utt").applyInPandas(run, "utt long, content binary")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(path, length): bytes of each file at a path, from the listing alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_floats(spark: SparkSession, path: str) -> DataFrame:
    """(utt, i, x) of headerless files of 32-bit floating-point samples of one channel; bytes of a cut-off last sample are left out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame({"path": [name], "x": [np.frombuffer(content, "<f4", count=len(content) // 4).astype(float).tolist()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x array<double>")
    return files.select(F.xxhash64("path").alias("utt"), F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def encoded_floats(signal: DataFrame) -> DataFrame:
    """(utt, content): each utterance's samples as 32-bit floating-point numbers without a header; a file is one utterance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"utt": [pdf["utt"].iloc[0]], "content": [pdf.sort_values("i")["x"].to_numpy("<f4").tobytes()]})

    return signal.select("utt", "i", "x").groupBy("utt").applyInPandas(run, "utt long, content binary")
