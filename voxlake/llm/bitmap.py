"""Blocked Bloom filters as small tables of bitmaps, with DataFrame functions alone.

A filter is a table of blocks of 32,768 bits. Its size has a fixed bound, so it may be broadcast however
many rows there are; a filter that is too small for its rows lets more of them through, and changes no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Bits of one block; all cells of a key lie in one block.
BLOCK_BITS = 32_768
#: Cells of each key, bits of the filter for each key, and the most blocks (64 MB).
CELLS = 3
BITS_PER_KEY = 16
MOST_BLOCKS = 16_384


def blocks_for(keys: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-keys * BITS_PER_KEY // BLOCK_BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _cell(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS)).cast("int")


def build(rows: DataFrame, key: str, blocks: int, at_least: int = 1) -> DataFrame:
    """(block, marked): the cells that `at_least` rows have hit, as one bitmap for each block.

    Counts for each cell are summed where the rows are before they move; the result has `blocks` rows at most.
    """
    cells = F.array_distinct(F.array(*[_cell(F.col(key), k) for k in range(CELLS)]))
    hit = rows.select(_block(F.col(key), blocks).alias("block"), F.explode(cells).alias("cell"))
    counted = hit.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return counted.groupBy("block").agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("marked"))


def _is_marked(marked: Column, cell: Column) -> Column:
    """Whether the bit is set; the bitmap's bytes hold the lowest bit first."""
    byte = F.conv(F.hex(F.substring(marked, F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(cell, F.lit(8)))), F.lit(2)) == 1


def test(rows: DataFrame, key: str, marks: DataFrame, blocks: int, out: str) -> DataFrame:
    """`rows` with a flag that is false only if the filter can't hold the row's key."""
    block, marked = fresh(rows.columns, "block", "marked")
    side = F.broadcast(marks.select(F.col("block").alias(block), F.col("marked").alias(marked)))
    held = rows.withColumn(block, _block(F.col(key), blocks)).join(side, block, "left")
    hits = [_is_marked(F.col(marked), _cell(F.col(key), k)) for k in range(CELLS)]
    return held.withColumn(out, F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))).drop(block, marked)


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """`rows` whose key is not in `gone`. Rows that a filter of the gone keys lacks stay where they are; only the rest are joined."""
    gone = checkpointed(gone.select(F.col(gone_key).alias("gone")).distinct())
    blocks = blocks_for(gone.count())
    (flag,) = fresh(rows.columns, "flag")
    tested = test(rows, key, checkpointed(build(gone, "gone", blocks)), blocks, flag)
    stay = tested.where(~F.col(flag)).drop(flag)
    met = tested.where(flag).drop(flag)
    return stay.unionByName(met.join(gone, met[key] == gone["gone"], "left_anti"))


def within(rows: DataFrame, key: str, chosen: DataFrame, chosen_key: str) -> DataFrame:
    """`rows` whose key is in `chosen`, with its columns (checkpointed, one row for each key). Only rows that a filter of its keys lets through are joined."""
    blocks = blocks_for(chosen.count())
    (flag,) = fresh([*rows.columns, *chosen.columns], "flag")
    marks = checkpointed(build(chosen.select(chosen_key).distinct(), chosen_key, blocks))
    return test(rows, key, marks, blocks, flag).where(flag).drop(flag).join(chosen.withColumnRenamed(chosen_key, key), key)
