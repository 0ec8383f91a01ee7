"""Windows over neighbours without one task for each utterance.

Rows of an utterance are cut into blocks of consecutive indices; each block also gets copies of the few rows
around it that its own rows look at. Windows then run over (utterance, block), so a long utterance is spread
over many tasks, at the price of copying a small share of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIZE = 65_536


def with_halo(df: DataFrame, index: str, before: int, after: int, size: int = SIZE) -> DataFrame:
    """`df` with `block` and `halo`: rows within `before` of the next block, or `after` of the one in front, are copied to it."""
    i, own = F.col(index), F.floor(F.col(index) / size)
    homes = [
        F.struct(own.alias("block"), F.lit(False).alias("halo")),
        F.when((i % size < after) & (own > 0), F.struct((own - 1).alias("block"), F.lit(True).alias("halo"))),
        F.when(i % size >= size - before, F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))),
    ]
    return df.withColumn("_home", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull()))).select(*df.columns, "_home.block", "_home.halo")


def over(index: str, *keys: str) -> WindowSpec:
    """The window of a block, in order of the index."""
    return Window.partitionBy(*keys, "block").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    """Without the copies; a block that holds nothing but copies vanishes with them."""
    return df.where(~F.col("halo")).drop("halo", "block")


def clamped(value: Column, shift: int, index: str, *keys: str) -> Column:
    """The value `shift` rows on, or that of the utterance's first or last row beyond its ends."""
    w = over(index, *keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if shift == 0:
        return value
    if shift > 0:
        return F.coalesce(F.lead(value, shift).over(w), F.last(value).over(whole))
    return F.coalesce(F.lag(value, -shift).over(w), F.first(value).over(whole))


#: Indices of a block's samples and the samples, where the block starts and its size; gives indices and values (numbers or rows of a matrix).
Run = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]
#: What is made of all rows of a batch before it goes out: from their indices and values, a row of values for each.
Then = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Values that are gathered before a batch goes out; a block's arrays weigh as much as so many values besides.
OUT, BESIDES = 250_000, 50


def _packed(made: list[tuple], kind: pa.DataType, name: str, then: Then | None) -> pa.RecordBatch:
    utt = pa.array([u for u, *_ in made], kind).take(pa.array(np.repeat(np.arange(len(made)), [len(at) for _, at, _ in made])))
    at, y = (np.concatenate([m[k] for m in made]) for k in (1, 2))
    if then is not None:
        y = np.ascontiguousarray(then(at, y))
    if y.ndim == 1:
        return pa.RecordBatch.from_arrays([utt, pa.array(at), pa.array(y)], names=["utt", name, "x"])
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
    return pa.RecordBatch.from_arrays([utt, pa.array(at), rows], names=["utt", name, "x"])


def _run(batches: Iterator[pa.RecordBatch], run: Run, size: int, name: str, then: Then | None = None) -> Iterator[pa.RecordBatch]:
    key, kind, held, made, waiting = None, None, [], [], 0

    def finish() -> int:
        """Makes what the block gives, and tells how many values it holds; a block too short for any is not kept."""
        i, x = (np.concatenate(c) for c in zip(*held, strict=True))
        at, y = run(i, x, key[1] * size, size)
        if not len(at):
            return 0
        made.append((key[0], at, y))
        return y.size + BESIDES

    for batch in batches:
        kind = batch.column("utt").type
        utt, block, i, x = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("utt", "block", "i", "x"))
        cuts = [0, *(np.flatnonzero((utt[1:] != utt[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(i)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and key != (utt[a], block[a]):
                waiting, held = waiting + finish(), []
                if waiting > OUT:
                    yield _packed(made, kind, name, then)
                    made, waiting = [], 0
            key = utt[a], block[a]
            held.append((i[a:b], x[a:b]))
    if held:
        finish()
    if made:
        yield _packed(made, kind, name, then)


def by_block(signal: DataFrame, before: int, after: int, run: Run, name: str = "i", matrix: bool = False, size: int = SIZE, then: Then | None = None) -> DataFrame:
    """(utt, `name`, x): what `run` makes of each block of a signal and of as many samples in front of and after it.

    Each sample is shuffled once, and a task holds one block and a batch of `OUT` values at a time. A null sample is 0.
    `then` goes on with the rows of a whole batch in the same Python worker.
    """
    size = max(size, before, after, 1)
    plain = signal.where("utt is not null").select("utt", F.col("i").cast("long").alias("i"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    own = with_halo(plain, "i", before, after, size).drop("halo").repartition("utt", "block").sortWithinPartitions("utt", "block", "i")
    schema = f"utt {signal.schema['utt'].dataType.simpleString()}, {name} long, x {'array<double>' if matrix else 'double'}"
    return own.mapInArrow(partial(_run, run=run, size=size, name=name, then=then), schema)
