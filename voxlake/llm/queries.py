"""The queries of this subpackage, as the entry module registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontaminate, exact_dedup, lm_score, packing, pii, quality, simhash, token_counts, toxicity, trie
from .common import held_out, table, text_of


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, tokenizer_path(), ids="ids", decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "at", "matched", "window")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.counted("base", k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = lm_score.train(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return lm_score.score(docs, models).select("doc_id", *lm_score.ADDED)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits of each: a deletion, an insertion and a new ending."""
    import public_tokenizers

    size = F.length(text_of())
    edit = lambda start, stop, new: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(new).alias("new"))
    quarter = F.floor(size / 4)
    edits = F.array(edit(quarter, quarter + 10, ""), edit(F.floor(size / 2), F.floor(size / 2), " (edited) "), edit(size - 5, size, "'re done."))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    counted = token_counts.count_edited(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.select("doc_id", *token_counts.ADDED)


#: The tools that a conversation's users and system call: a turn of theirs is a call that refers to the call before
#: it, and the assistant's turn right after one is its result.
REPLY_SCHEMA = """{"type": "object", "required": ["prompt", "turn"], "additionalProperties": false,
 "properties": {"prompt": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}}"""
TOOLS = {"reply": REPLY_SCHEMA, "instruct": REPLY_SCHEMA.replace("20", "5")}


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.where("role in ('user', 'system')").withColumn("before", before)
    after = F.when(F.col("before").isNotNull(), F.struct(name(F.col("before")).alias("$ref")))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"), after.alias("after")))
    tool = F.when(F.col("role") == "user", "reply").otherwise("instruct")
    calls = asked.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return chat.link(calls, results, TOOLS)


OP8_SQL = """
WITH c AS (SELECT conv_id, turn, role, conv_id || ':' || turn AS call_id, text, lag(turn) OVER w AS before, row_number() OVER w - 1 AS level
  FROM conversations WHERE role IN ('user', 'system') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status, CAST(coalesce(level, 0) AS INTEGER) AS level,
  c.text AS prompt, c.turn AS asked, before, r.text AS result, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS results, c.call_id IS NOT NULL AS called,
  CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'instruct' END AS tool, CASE role WHEN 'system' THEN 5 ELSE 20 END AS least FROM c FULL JOIN r ON c.call_id = r.call_id)
SELECT conv_id, turn, call_id, status, level, results, called AND length(prompt) >= least AS valid,
  CASE WHEN called AND length(prompt) < least THEN '$.prompt: length' ELSE '' END AS errors,
  CAST(json_object('arguments', CASE WHEN NOT called THEN NULL WHEN before IS NULL THEN json_object('prompt', prompt, 'turn', asked)
      ELSE json_object('after', json_object('$ref', conv_id || ':' || before), 'prompt', prompt, 'turn', asked) END, 'id', call_id, 'level', level,
    'name', tool, 'result', result, 'results', results, 'status', status) AS VARCHAR) AS json
FROM j
"""


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turns are those of another one: h turns of conversation c - c mod 5, h being crc32(c) mod 9."""
    own = trie.sequences(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return trie.nodes(trie.rebuilt(own, c - c % 5, F.crc32(c.cast("string")) % 9, 8))


OP12_SQL = """
WITH RECURSIVE step AS (SELECT range AS i, 0 AS k, range AS v FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 9 AS h FROM own, crc),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(o.s, [])[1:h], h.s[h + 1:]) AS s FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5),
beginnings AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt),
node AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].text) END) AS size,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(s)), '') AS ends FROM beginnings GROUP BY ALL),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
known AS (SELECT node.*, coalesce(child.n, 0) AS children FROM node LEFT JOIN child USING (p)),
parts AS (SELECT *, unnest(range(d + 1)) AS k FROM known),
below AS (SELECT p[1:k] AS p, sum((n - 1) * size) AS saved, count(*) FILTER (children = 0) AS leaves FROM parts GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.children AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM known a JOIN below USING (p) LEFT JOIN node b ON a.d > 0 AND b.p = a.p[1:a.d - 1]
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
inside AS (SELECT lang, array_to_string(w[k:k + 1], ' ') AS phrase, max(a) AS top FROM c, (VALUES (1), (2)) AS s(k) WHERE size = 3 GROUP BY ALL),
stays AS (SELECT c.* FROM c LEFT JOIN inside i ON c.size = 2 AND c.lang = i.lang AND c.phrase = i.phrase WHERE top IS NULL OR 100 * top < 50 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM stays, (VALUES (1), (2)) AS s(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.a, k, h.n AS l, r.n AS r, CAST(1000000::HUGEINT * c.a * c.a // (h.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM ranked JOIN total t USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op8_chat": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
