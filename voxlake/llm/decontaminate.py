"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

A seed hashes the tokens that a fixed mask selects in a window and ignores the others, so a substitution at
an ignored place leaves it the same. Seeds of documents meet those of the benchmark; around each hit the two
texts are laid side by side and compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import checkpointed, fresh, text_of

#: Least tokens of an item that may be substituted, and the offsets that each mask selects. Wherever the
#: substitutions of an accepted overlap lie (up to 3 in 12 tokens, 2 in 8 to 11), one mask at one place selects
#: none of them; a test counts all placements.
SPAN = 8
MASKS = ((0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 6, 7))
#: Items of WHOLE to SPAN - 1 tokens are sought by their first tokens, and must occur whole; shorter ones must be the whole document.
WHOLE, FIRST = 4, (0, 1, 2, 3)
#: An overlap is a stretch of WINDOW tokens (all of a shorter item) in which this share is equal.
WINDOW, SHARE = 12, 0.75
#: Seeds of a benchmark that are broadcast at a time (about 100 MB).
BROADCAST_SEEDS = 2_000_000
#: Tokens before and after a seed's first one that a window with that seed may lie on.
AROUND = range(-7, WINDOW)
#: ASCII other than letters and digits separates tokens.
BREAKS = "[\\x00-/:-@\\[-`{-\\x7f]+"


def tokens(text: str) -> Column:
    """Hashes of the lower-case tokens of a whole text."""
    return F.transform(F.filter(F.split(F.lower(text_of(text)), BREAKS), lambda t: t != ""), lambda t: F.xxhash64(t))


def seeded(rows: DataFrame, found: str, short: bool = True) -> DataFrame:
    """`rows` with (at, seed) for each place of the token array and each mask that fits there.

    With `short` the seeds of items under SPAN tokens are among them: of each place's next tokens, and of an
    array that is itself shorter than WHOLE.
    """
    size, at = F.size(found), F.col("at")
    seed = lambda k, mask: F.xxhash64(F.lit(k), *[F.get(found, at + o) for o in mask])
    each = [F.when(at + mask[-1] < size, seed(k, mask)) for k, mask in enumerate([*MASKS, *([FIRST] if short else [])])]
    if short:
        each.append(F.when((at == 0) & (size < WHOLE), seed(-1, range(WHOLE - 1))))
    placed = rows.select(*rows.columns, F.posexplode(found).alias("at", "_token"))
    return placed.select(*rows.columns, "at", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def surroundings(found: str, at: str) -> Column:
    """A hash of all tokens that a window with the seed at a place may lie on, and of where the array ends among them.

    Places of one array with the same seed and surroundings lead to the same windows, so one of them stands for all:
    the first in a document, the last in an item, as of equal overlaps the one that begins first is reported.
    """
    return F.xxhash64(*[F.coalesce(F.get(found, F.col(at) + o), F.lit(0)) for o in AROUND])


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item): token hashes of each different benchmark text, under its smallest id. Texts without tokens are left out."""
    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), tokens(text).alias("item"))
    return own.where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"))


def row_key(doc_id: str, text: str) -> Column:
    """128 bits that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("-")), F.lit("\0"), text_of(text)).cast("binary")))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = BROADCAST_SEEDS) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, row_key, at, matched, window.

    matched counts the equal tokens of the best window of `window` tokens, and `at` is where the item would
    begin in the document. At least 9 of 12 tokens are equal at the same places, or 3 of 4 of an item of 8 to
    11; an item of 4 to 7 tokens occurs whole, and a shorter one is the whole document. Benchmark texts with
    the same tokens are one item, under the smallest item_id; documents that repeat both id and text are one.
    Null texts are empty and overlap with nothing; a null doc_id is kept as null. Empty tables give no rows.

    Seeds of the corpus never move: those of the benchmark are broadcast, `most` at a time. Only hits are
    shuffled, one for each seed and its surroundings, so repeated tokens don't multiply; a document meets its own
    hits and the tokens of their items.
    """
    items = checkpointed(items_of(benchmark))
    n = F.size("item")
    short = not items.where(n < SPAN).isEmpty()
    index = seeded(items.select("item_id", "item", n.alias("n")), "item", short).withColumn("around", surroundings("item", "at")).withColumnRenamed("at", "item_at")
    # Of a long item all masks count, of a shorter one only the seed that its length is sought by.
    kinds = (F.col("n") >= SPAN) | (F.col("item_at") == 0)
    index = index.where(kinds).groupBy("seed", "item_id", "n", "around").agg(F.max("item_at").alias("item_at"))
    index = checkpointed(index.groupBy("seed", "item_id", "n").agg(F.collect_set("item_at").alias("item_at")))
    blocks = -(-index.count() // max(1, most)) if most else 3
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    own = own.withColumn("row_key", row_key("doc_id", "text"))
    placed = seeded(own.select("row_key", tokens("text").alias("found")), "found", short)
    hits = None
    for block in range(max(1, blocks)):  # as many as the benchmark's size calls for
        side = index.where(F.pmod(F.col("seed"), F.lit(blocks)) == block) if blocks > 1 else index
        met = placed.join(F.broadcast(side.select("seed", "item_id")), "seed").select("row_key", "item_id", "seed", surroundings("found", "at").alias("around"), "at")
        met = met.groupBy("row_key", "item_id", "seed", "around").agg(F.min("at").alias("at")).join(F.broadcast(side), ["seed", "item_id"])
        met = met.select("row_key", "item_id", "n", F.explode(F.transform("item_at", lambda q: F.col("at") - q)).alias("at"))
        met = checkpointed(met.distinct())
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.distinct() if blocks > 1 else hits
    # Only documents with hits are read again in full; a filter of their keys keeps the others where they are.
    keys = hits.select("row_key").distinct()
    size = bitmap.blocks_for(keys.count())
    again = bitmap.test(own, "row_key", checkpointed(bitmap.build(keys, "row_key", size)), size, "hit").where("hit")
    again = again.select("doc_id", "row_key", tokens("text").alias("found")).dropDuplicates(["row_key", "doc_id"])
    # Hits come to a document's tokens as one list, and only the tokens that an item lies on go on from there.
    listed = again.join(hits.groupBy("row_key").agg(F.collect_list(F.struct("item_id", "n", "at")).alias("hits")), "row_key")
    each = listed.select("doc_id", "row_key", F.size("found").alias("total"), "found", F.explode("hits").alias("h"))
    each = each.select("doc_id", "row_key", "total", "h.item_id", "h.at", F.slice("found", F.greatest("h.at", F.lit(0)) + 1, F.col("h.n")).alias("found"))
    laid = _laid(each, items)
    need = F.when(n >= SPAN, F.ceil(F.col("window") * SHARE)).when((n >= WHOLE) | (F.col("total") == n), n)
    window = F.least(F.lit(WINDOW), n)
    same = _same(F.col("found"), F.col("item"), F.least("at", F.lit(0)))
    # Bound as an array of one, so that it isn't made anew for each window.
    matched = F.get(F.transform(F.array(same), lambda own: _best(own, window)), 0)
    need = F.when(n >= SPAN, F.ceil(window * SHARE)).when((n >= WHOLE) | (F.col("total") == n), n)
    best = laid.select("doc_id", "row_key", "item_id", window.alias("window"), need.alias("need"), matched.alias("matched"), "at")
    best = best.groupBy("doc_id", "row_key", "item_id", "window", "need").agg(F.max(F.struct("matched", (-F.col("at")).alias("at"))).alias("b")).where("b.matched >= need")
    return best.select("doc_id", "item_id", "row_key", (-F.col("b.at")).alias("at"), F.col("b.matched").alias("matched"), "window")


#: Tokens of a benchmark whose items are broadcast (64 MB at most); beyond, hits are salted by so many copies of each item.
BROADCAST_TOKENS, SALT = 8_000_000, 32


def _laid(each: DataFrame, items: DataFrame) -> DataFrame:
    """Hits with the tokens of their items; a passage that very many documents share is spread over many tasks."""
    if (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_TOKENS:
        return each.join(F.broadcast(items), "item_id")
    copies = items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return each.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALT))).join(copies, ["item_id", "salt"]).drop("salt")


def _same(found: Column, item: Column, at: Column) -> Column:
    """1 for each token of the item that the document has at the same place, else 0."""
    return F.transform(item, lambda t, q: F.when(F.get(found, at + q) == t, 1).otherwise(0))


def _best(same: Column, window: Column) -> Column:
    """The most ones in any window."""
    starts = F.sequence(F.lit(1), F.size(same) - window + 1)
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, window), F.lit(0), lambda a, b: a + b)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that overlap with no benchmark item, with all their columns."""
    gone = overlaps(docs, benchmark, doc_id, text)
    (key,) = fresh(docs.columns, "row_key")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    return bitmap.without(keyed, key, gone, "row_key").drop(key)
