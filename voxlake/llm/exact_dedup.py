"""Exact deduplication by a Bloom filter built in two passes, with DataFrame functions alone.

Pass one hashes every text and marks the filter cells that two or more rows have hit. Pass two tests every
row: only rows all of whose cells are marked can have an equal, so they alone are shuffled by the text's
digest; every other row passes straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import blocks_for, build, test
from .common import SPACE, checkpointed, fresh, text_of, with_group


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def groups_of(suspects: DataFrame, digest: str, doc_id: str) -> DataFrame:
    """(digest, keep_id, group_size) of rows that may be repeated; partial sums go first, so hot groups are small."""
    return suspects.groupBy(digest).agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once each run of white space is one space; null counts as empty. The row
    with the smallest doc_id stays; a null doc_id comes last. Rows that repeat both doc_id and text are one
    document: each gets the same decision (`deduplicate` returns one of them). An empty table gives none.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"))
    own = checkpointed(own)
    rows = own.count()
    blocks = blocks_for(rows)
    flagged = test(own, "text_sha256", build(own, "text_sha256", blocks, at_least=2), blocks, "again")
    flagged = checkpointed(flagged)
    alone = flagged.where(~F.col("again")).select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = flagged.where("again").drop("again")
    grouped = with_group(suspects, checkpointed(groups_of(suspects, "text_sha256", "doc_id")), "text_sha256", "group_size", rows)
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `decisions`.

    Of rows that repeat doc_id and text, any one stays. Rows whose digest the filter has seen once pass
    straight through with their texts; only suspects meet the groups.
    """
    digest, again, key = fresh(docs.columns, "digest", "again", "key")
    full = docs.withColumn(digest, F.sha2(normalised(text), 256)).withColumn(key, F.col(doc_id).cast("long"))
    own = checkpointed(full.select(digest, key))
    rows = own.count()
    blocks = blocks_for(rows)
    marks = checkpointed(build(own, digest, blocks, at_least=2))
    suspects = test(own, digest, marks, blocks, again).where(again).drop(again)
    # Of each group the key that stays, and whether more than one row has it.
    groups = suspects.groupBy(digest, key).agg(F.count(F.lit(1)).alias("n")).groupBy(digest)
    groups = checkpointed(groups.agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), F.col("n"))).alias("first")))
    stays = groups.select(digest, F.col("first.id").alias(f"{key}_stays"), F.col("first.n").alias(f"{key}_n"))
    flagged = test(full, digest, marks, blocks, again)
    alone = flagged.where(~F.col(again)).select(docs.columns)
    # One row of each group remains after this equality of digest and key, so no group gathers its texts.
    met = flagged.where(again).join(stays, (flagged[digest] == stays[digest]) & flagged[key].eqNullSafe(stays[f"{key}_stays"]))
    met = met.drop(stays[digest])
    once = met.where(F.col(f"{key}_n") == 1).select(docs.columns)
    more = met.where(F.col(f"{key}_n") > 1).dropDuplicates([digest]).select(docs.columns)
    return alone.unionByName(once).unionByName(more)
