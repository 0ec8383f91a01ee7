"""Feature, label, mark and model files as tables, and the text forms in which they are written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gmm import Mixture


def read_features(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, frame, base) of raw float32 matrices with `width` columns; a file of another length is an error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.frombuffer(bytes(content), "<f4")
                if len(x) % width:
                    raise ValueError(f"{name} has no whole number of frames")
                x = x.reshape(-1, width).astype(float)
                yield pd.DataFrame({"path": name, "frame": np.arange(len(x)), "base": x.tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame long, base array<double>")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, sad) of files of 0s and 1s between white space; a file is read as one text."""
    own = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_extract_all("value", F.lit("[01]"), 0).alias("s"))
    return own.select("path", F.posexplode("s").alias("frame", "sad")).select("path", F.col("frame").cast("long").alias("frame"), F.col("sad").cast("int").alias("sad"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """(path, tag, start_s, dur_s) of lines `tag start duration`; blank lines are left out."""
    part = F.split(F.trim("value"), r"\s+")
    own = spark.read.text(path).where("trim(value) <> ''").select(F.input_file_name().alias("path"), part.alias("p"))
    return own.select("path", F.get("p", F.lit(0)).alias("tag"), F.get("p", F.lit(1)).cast("double").alias("start_s"), F.get("p", F.lit(2)).cast("double").alias("dur_s"))


def parse_mixture(data: bytes) -> Mixture:
    """A mixture file: a SPHERE-like header, then float32 log weights, means, log determinants, inverse variances."""
    size = int(data[8:16])
    fields = dict(re.findall(rb"(\S+) -\w+ ([^\n]*)", data[:size]))
    m, d = int(fields[b"mixture_order"]), int(fields[b"sample_size"])
    x = np.frombuffer(data, "<f4", offset=size).astype(float)
    if len(x) != 2 * m + 2 * m * d:
        raise ValueError("the file's length doesn't fit its header")
    parts = np.split(x, np.cumsum([m, m * d, m]))
    return Mixture(parts[0], parts[2], parts[1].reshape(m, d), parts[3].reshape(m, d))


def mixture_bytes(model: Mixture) -> bytes:
    header = f"NIST_1A\n   1024\nsample_size -i {model.mean.shape[1]}\nmixture_order -i {model.mean.shape[0]}\nend_head\n".encode()
    body = np.concatenate([model.log_weight, model.mean.ravel(), model.log_det, model.inv_var.ravel()]).astype("<f4").tobytes()
    return header.ljust(1024, b"\0") + body


def read_mixture(spark: SparkSession, path: str) -> Mixture:
    """A model of bounded size, read where Spark reads and gathered on the driver."""
    return parse_mixture(bytes(spark.read.format("binaryFile").load(path).select("content").head()["content"]))


def read_matrix(spark: SparkSession, path: str, columns: int, kind: str = "<f4") -> np.ndarray:
    """A raw matrix (total variability: float32, projection: float64) of bounded size."""
    return np.frombuffer(bytes(spark.read.format("binaryFile").load(path).select("content").head()["content"]), kind).astype(float).reshape(-1, columns)


def read_models(spark: SparkSession, config: dict) -> dict[str, Mixture]:
    """The mixtures that a configuration names under `gmm_models`, from files in its `model_dir`."""
    folder = config.get("model_dir", "")
    return {name: read_mixture(spark, f"{folder}/{file}" if folder else file) for name, file in config["gmm_models"].items()}


def vector_bytes(vectors: DataFrame, name: str = "vec", kind: str = "<f8") -> DataFrame:
    """`vectors` with `content`: the vector's numbers as bytes without a header."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("content", T.BinaryType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(content=[np.asarray(v, kind).tobytes() for v in pdf[name]])

    return vectors.mapInPandas(run, schema)


def label_lines(frames: DataFrame) -> DataFrame:
    """(utt, frame, line): one line, 0 or 1, for each frame."""
    return frames.select("utt", "frame", F.col("sad").cast("string").alias("line"))


def segment_marks(segments: DataFrame, step_ms: float, audacity: bool = False) -> DataFrame:
    """(utt, start, line) of segments in frames: `int start duration`, or `start end int`, in seconds."""
    s = step_ms / 1000
    start, stop = F.col("start") * s, F.col("stop") * s
    line = F.format_string("%.2f %.2f int", start, stop) if audacity else F.format_string("int %.2f %.2f", start, stop - start)
    return segments.select("utt", "start", line.alias("line"))


def cluster_marks(segments: DataFrame, step_ms: float, audacity: bool = False) -> DataFrame:
    """(utt, start, line) of clustered segments: `c<k> start duration`, or tab-separated `start end c<k>`."""
    s = step_ms / 1000
    tag = F.concat(F.lit("c"), F.col("cluster"))
    start, stop = F.col("start") * s, F.col("stop") * s
    line = F.format_string("%.2f\t%.2f\t%s", start, stop, tag) if audacity else F.format_string("%s %.2f %.2f", tag, start, stop - start)
    return segments.select("utt", "start", line.alias("line"))


def cluster_xml(segments: DataFrame, step_ms: float) -> DataFrame:
    """(utt, start, element): one XML element for each segment, with times in whole milliseconds."""
    ms = lambda c: F.floor(F.col(c) * step_ms).cast("string")
    element = F.concat(F.lit('<segment start="'), ms("start"), F.lit('" end="'), ms("stop"), F.lit('"><model>c'), F.col("cluster").cast("string"), F.lit("</model></segment>"))
    return segments.select("utt", "start", element.alias("element"))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a key numbered from 0 in an order."""
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
