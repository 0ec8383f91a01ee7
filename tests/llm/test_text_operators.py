"""Operators on single texts: encoding, counting, scoring, personal data."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxlake.llm import bpe, lm_score, pii, quality, token_counts, toxicity
from voxlake.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, score double, ids string, block int, flag string, `key` int, n_tokens string, word string"
ODD = [None, "", " ", "a", "word " * 30_000, "x" * 50_000, "same text here", "same text here", "É à ß　İ\x00\x1c\U0001f600 <|endoftext|> it's 12", "\n\n\t", "+1 (229) 555-4838 a@b.org"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, 0.5, "i", 1, "f", 2, "n", "w") for k, t in enumerate(ODD)] + [(None, "no id", 0.5, "i", 1, "f", 2, "n", "w"), (6, "same text here", 0.5, "i", 1, "f", 2, "n", "w")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encoder_equals_library():
    own, other = bpe.encoder(tokenizer_path()), library()
    rng = random.Random(5)
    pools = [[chr(i) for i in range(0x250)], list("etaoin shrdlu'"), ["<|endoftext|>", "<|", "ing", " ", "É", "'re", "1"], [chr(i) for i in (*range(0x300, 0x310), *range(0x1F600, 0x1F610), *range(0x3A0, 0x3D0), 0x2028, 0x200D)]]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randrange(30)))
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_compatibility_is_that_of_merging():
    """A pair of tokens is compatible exactly if the text of both is encoded as the two."""
    own = bpe.encoder(tokenizer_path())
    plain = [i for i, s in enumerate(own.strings[:49406]) if not s.endswith("</w>") and s.isascii() and s.isalpha() and s.islower()]
    ended = [i for i, s in enumerate(own.strings[:49406]) if s.endswith("</w>") and s[:-4].isascii() and s[:-4].isalpha() and s[:-4].islower()]
    rng, other = random.Random(1), library()
    for _ in range(1500):
        a, b = rng.choice(plain), rng.choice(ended)
        got = other.encode(own.strings[a] + own.strings[b][:-4], add_special_tokens=False).ids
        assert own.compatible(a, b) == (got == [a, b])


def test_encode_and_decode_tables(spark, odd):
    other = library()
    rows = bpe.decode(bpe.encode(odd, tokenizer_path(), ids="ids", decoded="d"), tokenizer_path(), decoded="again").collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = other.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["d"] == r["again"] == other.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), tokenizer_path()).count() == 0
    assert set(odd.columns) <= set(bpe.encode(odd, tokenizer_path()).columns)


def test_token_counts_follow_edits(spark, odd):
    import base64

    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    full = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern, counter = token_counts.splitter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "'", "r", "e", "  ", "\n", " ", "1", "é", "word", "!!", "'re"]
    for _ in range(400):
        own = token_counts.CountedText("".join(rng.choices(parts, k=rng.randrange(150))), pattern, counter)
        for _ in range(5):
            at = rng.randrange(-1, len(own.text) + 2)
            own.edit(at, at + rng.randrange(6), "".join(rng.choices(parts, k=rng.randrange(4))))
            assert own.tokens == len(full.encode_ordinary(own.text))
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("stop"), F.lit("new").alias("new")), F.lit(None))
    for r in token_counts.count_edited(odd.withColumn("edits", F.when(F.col("doc_id") != 3, edits)), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        text = r["text"] or ""
        changed = text if r["edits"] is None else text[:2] + "new" + text[4:]
        assert (r["n_tokens"], r["n_tokens_edited"]) == (len(full.encode_ordinary(text)), len(full.encode_ordinary(changed)))
    assert token_counts.count_edited(odd.limit(0).withColumn("edits", edits), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_kept_trees_take_one_batch_of_edits_after_another(spark, odd):
    """Trees go out and come in as columns; a second batch of edits encodes only what it touches."""
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    split, counter = token_counts.splitter(path, pattern)
    kept = token_counts.segment(odd, path, pattern)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for start, stop, new in ((2, 4, "new"), (1, 1, " x'"), (0, 3, "")):
        edits = F.array(F.struct(F.lit(start).alias("start"), F.lit(stop).alias("stop"), F.lit(new).alias("new")))
        kept = token_counts.edit(kept.withColumn("edits", F.when(F.col("doc_id") != 3, edits)), path, pattern)
        assert set(odd.columns) - {"n_tokens"} <= set(kept.columns)
        for r in kept.collect():
            if r["doc_id"] not in (3, None):
                t = texts[r["doc_id"]]
                a, b = min(start, len(t)), max(min(start, len(t)), min(stop, len(t)))
                whole = t[:a] + new + t[b:]
                assert (r["text"] or "") == whole and r["n_tokens"] == sum(counter[p] for p in split.findall(whole))
                assert np.frombuffer(r["piece_sizes"], "<u4").tolist() == [len(p) for p in split.findall(whole)] and r["n_pieces_encoded"] < 20
            else:
                assert r["n_pieces_encoded"] == 0
        texts = {r["doc_id"]: r["text"] or "" for r in kept.collect()}


def test_edits_encode_little():
    pattern, counter = token_counts.splitter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = token_counts.CountedText("some words here " * 5_000, pattern, counter)
    own.edit(40_000, 40_003, "xyz")
    assert own.encoded < 12


@pytest.mark.parametrize(("name", "label", "cut", "least"), [("op3_quality", "quality", 0.5, 0.97), ("op7_toxicity", "toxic", 0.7, 0.85)])
def test_held_out_accuracy(spark, name, label, cut, least):
    found = {r["doc_id"]: r for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r[label], found[r["doc_id"]]) for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(f["held_out"] for _, f in held) and all(0 <= f["score"] <= 1 and f["predicted"] == (f["score"] >= cut) for f in found.values())
    assert np.mean([y == f["predicted"] for y, f in held]) >= least
    if label == "toxic":
        assert np.mean([f["predicted"] for y, f in held if y]) > 0.75


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_odd_tables(spark, odd, module):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        model = module.train(odd, own)
        scored = module.score(odd, model)
        assert scored.count() == odd.count() and scored.where("score between 0 and 1").count() == odd.count()
        assert scored.where("text = 'same text here'").select("score").distinct().count() == 1
    assert module.score(odd.limit(0), model).count() == 0
    x = module.score(odd.drop("score"), model, out="own")
    assert set(odd.drop("score").columns) <= set(x.columns)


def test_preferences_rank_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 3] > 0.5).astype(int)
    model = quality.fit_preferences(x, y)
    assert ((model.score(x) >= 0.5).astype(int) == y).mean() > 0.97
    assert abs((model.score(x) >= 0.5).mean() - y.mean()) < 0.01  # the quantile of the scores is the threshold


def test_ftrl_weights_are_few():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "of", "and", "house", "tree", "run"], k=40)) + (" vile" if k % 4 == 0 else "") for k in range(400)]
    rows, y = [np.unique(toxicity.grams(t)) for t in texts], [int(k % 4 == 0) for k in range(400)]
    model = toxicity.fit(rows, y)
    table = model.dense()
    assert len(model.index) < 60
    assert all((model.score(x, table) >= 0.7) == bool(label) for x, label in zip(rows, y, strict=True))


def brute_losses(texts, wanted):
    """Both models by counting words and pairs, without hashing."""
    words = [lm_score.words_of(t) for t in texts]
    size = len({w for ws in words for w in ws})
    counts = []
    for keep in ([True] * len(texts), wanted):
        single = Counter(w for ws, k in zip(words, keep, strict=True) if k for w in ws)
        pair = Counter(p for ws, k in zip(words, keep, strict=True) if k for p in zip(ws, ws[1:], strict=False))
        counts.append((single, pair, sum(single.values())))
    out = []
    for ws in words:
        losses = []
        for single, pair, total in counts:
            loss = 0.0
            for j, w in enumerate(ws):
                one = (1 - lm_score.SPREAD) * single[w] / total + lm_score.SPREAD / size
                before = single[ws[j - 1]] if j else 0
                loss -= math.log(lm_score.MIX * pair[ws[j - 1], w] / before + (1 - lm_score.MIX) * one if before else one)
            losses.append(loss / len(ws) if ws else 0.0)
        out.append((losses[1], losses[0]))
    return out


def test_lm_equals_counting(spark, odd):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["red", "blue", "green", "one", "two", "Two."], k=rng.randrange(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = [k % 3 == 0 for k in range(60)]
    marked = spark.createDataFrame([(k,) for k in range(60) if wanted[k]] + [(None,), (3,)], "doc_id long")
    models = lm_score.train(docs, marked)
    want = brute_losses(texts, wanted)
    for scored in (lm_score.score(docs, models), lm_score.score(docs.select("*"), models)):  # by the counted documents' own messages, and as others
        rows = scored.collect()
        assert len(rows) == 60
        for r in rows:
            assert (r["target_loss"], r["background_loss"]) == pytest.approx(want[r["doc_id"]], abs=1e-9)
            assert r["difference"] == pytest.approx(r["target_loss"] - r["background_loss"])
    assert lm_score.score(odd, models).count() == odd.count()
    assert lm_score.score(odd.limit(0), lm_score.train(odd.limit(0), marked)).count() == 0
    same = lm_score.train(odd, marked.limit(0))
    scored = lm_score.score(odd, same)
    assert scored.where("abs(difference) > 1e-9").count() == 0 and scored.count() == odd.count()
    assert set(odd.columns) <= set(scored.columns) and scored.where("text = 'same text here'").select("background_loss").distinct().count() == 1


@pytest.mark.parametrize(("chunk", "part"), [(3_000, 500), (lm_score.CHUNK, lm_score.PART)])
def test_lm_counts_every_word(spark, chunk, part):
    """Far more words and bigrams than a part sums or a chunk sends."""
    rng = random.Random(5)
    names = [f"w{k}é" for k in range(40_000)]
    texts = [" ".join(names[k * 500 : k * 500 + 500]) for k in range(80)] + [" ".join(rng.choices(names, k=rng.randrange(40))) for _ in range(200)] + ["w1 w2", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = [k % 3 == 0 for k in range(len(texts))]
    models = lm_score.train(docs, spark.createDataFrame([(k,) for k in range(len(texts)) if wanted[k]], "doc_id long"))
    want = brute_losses(texts, wanted)
    got = {r["doc_id"]: r for r in lm_score.score(docs, models, chunk=chunk, part=part).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k]["n_words"] == len(lm_score.words_of(texts[k]))
        assert (got[k]["target_loss"], got[k]["background_loss"]) == pytest.approx(w, abs=1e-9)


def test_lm_scores_do_not_depend_on_the_background_size(spark):
    """The same target against a background of 2 and of 200 times its size: a word that the target lacks costs much the same."""
    costs = []
    for times in (2, 200):
        texts = ["red blue green"] * 10 + ["one two three"] * (10 * times) + ["unseen here"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        models = lm_score.train(docs, spark.createDataFrame([(k,) for k in range(10)], "doc_id long"))
        costs.append(lm_score.score(docs, models).where("text = 'unseen here'").first()["target_loss"])
    assert costs[0] == pytest.approx(costs[1])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans_equal_brute_force(spark, odd):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.y", "1", "22", "255", "256", "0", ".", " ", "-", "+1", "(", "4111111111111111", "4111 1111 1111 1111", "+1 (229) 555-4838", "é", "😀", "_", "1.2.3.4", "\n", "00", "[at]", "call "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(800)] + ODD + ["1" * 50_000, "x@" + "a." * 20_000, "+1" + "(" * 50_000, "a." * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        base = brute_base(texts[r["doc_id"]] or "")
        assert [tuple(x) for x in r["base"]] == base
        assert set(base) <= {tuple(x) for x in r["spans"]} and [tuple(x) for x in r["spans"]] == sorted(map(tuple, r["spans"]))
    assert pii.detect(odd).count() == odd.count()
    assert pii.detect(odd.limit(0)).count() == 0


def test_pii_adds_spans_that_labelers_agree_on(spark):
    rng = random.Random(9)
    texts = []
    for k in range(400):
        number = f"{rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        texts.append([f"please call +1 ({number} today", f"my phone is ({number}", f"write to ann.{k}@mail.example.com now", f"host 10.{k % 250}.3.4 is up", "nothing of the kind"][k % 5])
    texts += ["please call (229) 555-4838 today", "serial total 12", "order no 1234 5678 9012 3456 was sent"]
    rows = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[400]["spans"]] == [(3, 12, 26)] and not rows[400]["base"]
    assert not rows[401]["spans"] and not rows[402]["spans"] and not rows[4]["spans"]


def test_pii_expectations_equal_brute_force():
    """Every span a row of its own, in plain Python, against the counted patterns."""
    rng = random.Random(6)
    spans = []
    for _ in range(300):
        kind, truth = rng.randrange(5), rng.random() < 0.6
        spans.append((kind, *(-1 if rng.random() < 0.2 else int(rng.random() < (0.9 - 0.1 * j if truth else 0.1 + 0.1 * j)) for j in range(5))))
    counts = Counter(spans)
    rows = np.array([(*s, n) for s, n in counts.items()], float)
    p, share, true, false = pii.expectations(rows[:, 0].astype(int), rows[:, 1:-1], rows[:, -1], 20)
    shares, for_true, for_false = [0.5] * 5, [0.8] * 5, [0.2] * 5
    for _ in range(20):
        chance = []
        for kind, *votes in spans:
            a, b = shares[kind], 1 - shares[kind]
            for j, v in enumerate(votes):
                if v >= 0:
                    a, b = a * (for_true[j] if v else 1 - for_true[j]), b * (for_false[j] if v else 1 - for_false[j])
            chance.append(a / (a + b))
        for k in range(5):
            own = [c for c, s in zip(chance, spans, strict=True) if s[0] == k]
            shares[k] = (sum(own) + 1) / (len(own) + 2)
        for j in range(5):
            voted = [(c, s[1 + j]) for c, s in zip(chance, spans, strict=True) if s[1 + j] >= 0]
            clip = lambda v: min(max(v, 0.02), 0.98)
            for_true[j] = clip((sum(c for c, v in voted if v) + 8) / (sum(c for c, _ in voted) + 10))
            for_false[j] = clip((sum(1 - c for c, v in voted if v) + 2) / (sum(1 - c for c, _ in voted) + 10))
    assert np.allclose(share, shares) and np.allclose(true, for_true) and np.allclose(false, for_false)
    assert np.allclose([dict(zip(counts, p, strict=True))[s] for s in spans], chance)
    model = pii.fit([(*s, 1, 2, 1, 0, n) for s, n in counts.items()])
    assert all(r > 0.5 for r in model.reliability)


def test_pii_finds_planted_secrets_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: {tuple(x) for x in r["spans"]} - {tuple(x) for x in r["base"]} for r in pii.detect(docs).collect()}
    planted = 0
    for i, text in ((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()):
        want = {(4, m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
        planted += len(want)
        assert want <= found[i]
        assert all(k == 4 and re.search(r"(?i)token", text[max(0, a - 40) : a]) for k, a, _ in found[i])
    assert planted > 5


def test_pii_takes_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"a{k}@b{k}.org" for k in range(16_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    pii.detect(docs.limit(1)).collect()
    start = time.perf_counter()
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert [tuple(x) for x in rows[1]["base"]] == [(0, m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert rows[1]["spans"] == rows[1]["base"] and not rows[2]["spans"]
    assert time.perf_counter() - start < 30
