"""The driver's tables seen as signals, feature frames, models and segments, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, i, x): each user's events in order of time."""
    own = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return own.select(F.col("user_id").alias("utt"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("x"))


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, i, x): each supplier's line items, long enough for slow adaptation."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", *keys)
    w = Window.partitionBy("l_suppkey").orderBy(*keys)
    return own.select(F.col("l_suppkey").alias("utt"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, frame, base): embeddings as feature frames, one utterance for each label."""
    own = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return own.select(F.col("label").cast("long").alias("utt"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("embedding").cast("array<double>").alias("base"))


def sample_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, i, u): the UTF-8 bytes of documents as companded samples."""
    own = table(spark, sf_dir, "documents")
    pairs = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".."), 0)
    at = own.select(F.col("doc_id").alias("utt"), F.posexplode(pairs).alias("i", "h"))
    return at.select("utt", F.col("i").cast("long").alias("i"), F.conv("h", 16, 10).cast("int").alias("u"))


SIGNALS = "signals AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
BIG = "big AS (SELECT l_suppkey AS utt, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_quantity AS x FROM lineitem)"
FRAMES = "frames AS (SELECT CAST(label AS BIGINT) AS utt, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS base FROM embeddings)"
LONG = f"{FRAMES}, long AS (SELECT utt, frame, unnest(generate_series(0, 63)) AS d, unnest(base) AS v FROM frames)"
