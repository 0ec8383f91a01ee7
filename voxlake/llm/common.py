"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxlake-checkpoint-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, read again: what it holds is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable, rows: int = 512) -> Iterable:
    """Arrow batches in slices of some rows, so that a Python worker holds few texts at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like those wanted that clash with none that are taken."""
    taken = {x.lower() for x in taken}
    out = []
    for name in wanted:
        free = name
        while free.lower() in taken:
            free = f"{name}_{uuid.uuid4().hex[:8]}"
        taken.add(free.lower())
        out.append(free)
    return out


#: A group with more than one row in so many counts as hot: there can't be more hot groups than this.
HOT_SHARE = 1_000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Each row with the columns of its group (one row for each key that occurs, `size` rows of `total`).

    Hot groups are at most HOT_SHARE, so they are broadcast and their rows stay where they are; the rows of
    other groups are joined by key. `groups` should be checkpointed, as it is read twice.
    """
    (seen,) = fresh([*rows.columns, *groups.columns], "seen")
    hot = F.col(size) * HOT_SHARE > total
    first = rows.join(F.broadcast(groups.where(hot).withColumn(seen, F.lit(True))), key, "left")
    names = [*rows.columns, *(c for c in groups.columns if c != key)]
    done = first.where(F.col(seen).isNotNull()).select(names)
    rest = first.where(F.col(seen).isNull()).select(rows.columns)
    return done.unionByName(rest.join(groups.where(~hot), key).select(names))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32(doc_id as text) mod 3 is 1 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of labelled rows with at most `bound` ids, outside the held-out fold.

    The ids with the smallest hashes are taken, so the sample doesn't depend on the partitioning. `bound` is a
    documented parameter of the classifiers; the sampled ids are at most that many, so their broadcast is
    bounded too. Labels that are null, or that disagree for one doc_id, are left out. Rows that repeat a
    doc_id are all here: `one_each` takes one of them once their texts have become small.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_top"))
        .where(F.col("y") == F.col("_top")).drop("_top")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.join(F.broadcast(ids), "doc_id")


def one_each(sample: DataFrame) -> DataFrame:
    """(doc_id, x, y) of a sample: of rows that share a doc_id the one whose x comes first, by partial aggregation before they move."""
    return sample.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "x", "y")
