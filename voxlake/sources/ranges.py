"""Files of samples and vectors by byte ranges, and their writers, as Spark data sources.

Only a file's header is read when a read is planned; its body is cut into ranges of whole samples, each of which is a
partition, so a long file is many tasks and none holds it. Writers take utterances in order and stream each into
one file; files get their names only when all tasks have ended well.
"""

from __future__ import annotations

import fnmatch
import itertools
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SAMPLES = "path string, channel int, first long, sample_rate int, coding string, samples array<int>"
FLOATS = "path string, channel int, first long, sample_rate int, coding string, samples array<double>"
VECTORS = "path string, frame long, base array<double>"
#: Bytes of one partition, and samples of one row.
RANGE_BYTES, ROW = 32_000_000, 65_536


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, which may be a URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def whole(uri: str, path: str) -> str:
    """A path of a file system as a URI like the one that named the file system; a store's path begins with its bucket."""
    if "://" not in uri:
        return path
    scheme, host = re.match(r"([^:]+)://([^/]*)", uri).groups()
    return f"{scheme}://{host}{path}" if path.startswith("/") else f"{scheme}://{path}"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path, in a folder, or of names that fit a pattern in one folder."""
    files, own = store(path)
    folder, name = posixpath.split(own)
    if any(c in name for c in "*?["):
        found = [x for x in files.get_file_info(pafs.FileSelector(folder or ".")) if fnmatch.fnmatch(x.base_name, name)]
    else:
        found = files.get_file_info([own])
        if found[0].type == pafs.FileType.NotFound:
            raise ValueError(f"{path} does not exist")
        if found[0].type == pafs.FileType.Directory:
            found = [x for x in files.get_file_info(pafs.FileSelector(own)) if x.base_name[:1] not in "._"]
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File)


@dataclass(frozen=True)
class Body:
    """Where a file's samples lie, and what they are."""

    start: int
    stop: int
    rate: int
    channels: int
    kind: str
    coding: str

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize * self.channels


def sphere_body(file, size: int) -> Body:
    head = file.read(16)
    if not head.startswith(b"NIST_1A"):
        raise ValueError("not a SPHERE file")
    start = int(head[8:16])
    fields = dict(re.findall(rb"(\S+) -\w+ ([^\n]*)", file.read(start - 16)))
    coding = fields.get(b"sample_coding", b"pcm").split(b",")[0].decode()
    rate, width = int(fields.get(b"sample_rate", 0)), int(fields.get(b"sample_n_bytes", 2))
    if coding not in ("pcm", "ulaw", "alaw") or rate <= 0:
        raise ValueError(f"coding {coding} at {rate} Hz is not understood")
    kind = "u1" if coding != "pcm" or width == 1 else ">i2" if fields.get(b"sample_byte_format") == b"10" else "<i2"
    return Body(start, size, rate, int(fields.get(b"channel_count", 1)), kind, coding)


def wave_body(file, size: int) -> Body:
    """Of 16-bit PCM; chunks are skipped, not read, and may come in any order."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= size and (form is None or data is None):
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            data = at + 8, min(size, at + 8 + length)
        at += 8 + length + length % 2
    if form is None or data is None or form[0] != 1 or form[5] != 16:
        raise ValueError("only 16-bit PCM is understood")
    return Body(*data, form[2], form[1], "<i2", "pcm")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    first: int
    body: Body


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.form = options.get("form", "wave")
        if self.form not in ("wave", "sphere", "raw", "float", "features"):
            raise ValueError(f"no form is called {self.form}")

    def _body(self, path: str, size: int) -> Body:
        if self.form in ("wave", "sphere"):
            files, own = store(path)
            with files.open_input_file(own) as file:
                return (wave_body if self.form == "wave" else sphere_body)(file, size)
        if self.form == "features":
            width = int(self.options["width"])
            if size % (4 * width):
                raise ValueError(f"{path} has no whole number of frames")
            return Body(0, size, 0, width, "<f4", "features")
        return Body(0, size, int(self.options.get("rate", 0)), 1, "<i2" if self.form == "raw" else "<f4", "pcm")

    def partitions(self) -> list[Range]:
        most, out = int(self.options.get("bytes", RANGE_BYTES)), []
        for path, size in listed(self.options["path"]):
            path = whole(self.options["path"], path)
            body = self._body(path, size)
            count = (body.stop - body.start) // body.width
            each = max(1, most // body.width)
            for first in range(0, count, each):
                last = min(count, first + each)
                out.append(Range(path, body.start + first * body.width, body.start + last * body.width, first, body))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        body, at = partition.body, partition.first
        files, own = store(partition.path)
        with files.open_input_file(own) as file:
            file.seek(partition.start)
            left = (partition.stop - partition.start) // body.width
            while left:
                n = min(left, ROW if self.form != "features" else max(1, ROW // body.channels))
                x = np.frombuffer(file.read(n * body.width), body.kind).reshape(n, body.channels)
                if self.form == "features":
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, body.channels, dtype=np.int32)), pa.array(x.astype(float).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(at, at + n)), rows], names=["path", "frame", "base"])
                else:
                    kind = pa.float64() if self.form == "float" else pa.int32()
                    lists = pa.array([c.astype(kind.to_pandas_dtype()) for c in x.T], pa.list_(kind))
                    same = lambda v, t: pa.array([v] * body.channels, t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [same(partition.path, pa.string()), pa.array(range(body.channels), pa.int32()), same(at, pa.int64()), same(body.rate, pa.int32()), same(body.coding, pa.string()), lists],
                        names=["path", "channel", "first", "sample_rate", "coding", "samples"],
                    )
                at += n
                left -= n


class Ranges(DataSource):
    """`spark.read.format("voxlake_ranges")` with options path, form (wave, sphere, raw, float, features), rate, width and bytes."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_ranges"

    def schema(self) -> str:
        form = self.options.get("form", "wave")
        return VECTORS if form == "features" else FLOATS if form == "float" else SAMPLES

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class UtteranceWriter(DataSourceArrowWriter):
    """Rows (utt, n, values) in order of utterances: each becomes a file; n is what a header needs to know, the values of the whole."""

    def __init__(self, options: dict):
        self.form, self.rate, self.folder = options.get("form", "wave"), int(options.get("rate", 0)), options["path"]
        if self.form not in ("wave", "raw", "float", "features"):
            raise ValueError(f"no form is called {self.form}")
        self.waiting = f"{self.folder.rstrip('/')}/_waiting-{uuid.uuid4().hex}"

    def _head(self, n: int) -> bytes:
        if self.form != "wave":
            return b""
        size = 2 * n
        if size + 36 >= 1 << 32:
            raise ValueError("a WAVE file holds 4 GB at most")
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, self.rate, self.rate * 2, 2, 16) + b"data" + struct.pack("<I", size)

    def _packed(self, x: np.ndarray) -> bytes:
        if self.form in ("float", "features"):
            return x.astype("<f4").tobytes()
        whole = np.trunc(x) if self.form == "wave" else np.sign(x) * np.floor(np.abs(x) + 0.5)
        return np.clip(whole, -32768, 32767).astype("<i2").tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = store(self.waiting)
        mine, made, utt, out = f"{folder}/{uuid.uuid4().hex}", [], None, None
        for batch in iterator:
            keys = batch.column("utt").to_pylist()
            values = batch.column("values")
            a = 0
            for key, own in itertools.groupby(keys):
                b = a + len(list(own))
                if out is None or key != utt:
                    if out is not None:
                        out.close()
                    if not made:
                        files.create_dir(mine, recursive=True)
                    name = f"{key}.{ {'wave': 'wav', 'raw': 'raw', 'float': 'f32', 'features': 'feat'}[self.form] }"
                    utt, out = key, files.open_output_stream(f"{mine}/{name}")
                    out.write(self._head(int(batch.column("n")[a].as_py())))
                    made.append((f"{mine}/{name}", name))
                out.write(self._packed(np.asarray(values.slice(a, b - a).flatten(), float)))
                a = b
        if out is not None:
            out.close()
        return Written(made)

    def commit(self, messages: list[Written]) -> None:
        files, folder = store(self.folder)
        for message in messages:
            for source, name in message.files if message is not None else ():
                files.move(source, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        files, folder = store(self.waiting)
        if files.get_file_info([folder])[0].type == pafs.FileType.Directory:
            files.delete_dir(folder)


class Utterances(DataSource):
    """`df.write.format("voxlake_utterances")` with options path, form (wave, raw, float, features) and rate."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_utterances"

    def writer(self, schema: StructType, overwrite: bool) -> UtteranceWriter:
        return UtteranceWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    for source in (Ranges, Utterances):
        spark.dataSource.register(source)
    return spark


def read_ranges(spark: SparkSession, path: str, form: str = "wave", **options: int) -> DataFrame:
    """Blocks of samples (SAMPLES or FLOATS) or vectors (VECTORS) of all files at a path; see `Ranges` and `audio.exploded`."""
    reader = registered(spark).read.format("voxlake_ranges").option("form", form).option("path", path)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def write_signals(signal: DataFrame, folder: str, form: str = "wave", rate: int = 8000) -> None:
    """One file for each utterance of (utt, i, x): wave (cut toward zero), raw (16 bits, rounded) or float (32 bits), named by utt.

    An utterance's samples pass through a task in order; none holds it. Files of these names are replaced.
    """
    registered(signal.sparkSession)
    own = signal.where("utt is not null").select("utt", "i", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    counts = own.groupBy("utt").agg(F.count(F.lit(1)).alias("n"))
    rows = own.join(counts, "utt").repartition("utt").sortWithinPartitions("utt", "i").select(F.col("utt").cast("string").alias("utt"), "n", F.array("x").alias("values"))
    rows.write.format("voxlake_utterances").option("path", folder).option("form", form).option("rate", rate).mode("append").save()


def write_features(frames: DataFrame, folder: str) -> None:
    """One raw float32 matrix for each utterance of (utt, frame, base), its frames in order, named by utt."""
    registered(frames.sparkSession)
    own = frames.where("utt is not null").repartition("utt").sortWithinPartitions("utt", "frame")
    rows = own.select(F.col("utt").cast("string").alias("utt"), F.lit(0).cast("long").alias("n"), F.col("base").cast("array<double>").alias("values"))
    rows.write.format("voxlake_utterances").option("path", folder).option("form", "features").mode("append").save()
