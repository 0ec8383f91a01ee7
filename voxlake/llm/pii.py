"""Personal data by weak supervision, with DataFrame functions alone.

Patterns give candidate spans. Regex, checksum, gazetteer, context and border labelers vote on each;
expectation-maximisation over the counts of vote patterns estimates how reliable every labeler is, and a
logistic classifier of spans is trained on the resulting probabilities, which sees the votes and besides the
span's own make-up. Spans that meet the base rule of their kind always stay; the classifier adds others that
it is sure of: spelt-out addresses, numbers without a country code, IPv6 addresses and secrets such as keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of

#: Kinds in the order in which spans are listed; only the first four have a base rule.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns. A run of characters that can begin a match is only entered at its start or where the
#: last match ended, and nothing given up can match, so every pattern is linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose matches need the classifier.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<![0-9][\x20.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])(?![\x20.][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+(?![@.][A-Za-z0-9])",
}
#: A cheap test that a text can have matches at all.
NEEDS = {("email", False): "@", ("phone", False): "+", ("ip", True): ":"}

#: Gazetteers: fixed lists of domain endings, card issuers' first digits, calling codes, and words around spans.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "us", "ca")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "62", "35")
CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "52", "55", "61", "81", "86", "91")
CUES = {
    "email": "mail|contact|write|reply|address|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|address|client|login|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "call|phone|tel|mobile|cell|fax|contact|ring|anruf|appele|llam|dial",
    "secret": "token|secret|password|passwd|api|\\bkey\\b|bearer|credential|auth",
}
#: What stands right before a secret that is assigned to a name.
NAMED = r"(?:token|secret|password|passwd|key|bearer|credential|auth)[\"'\x20]*[=:]?[\"'\x20]*$"
AGAINST = "version|isbn|invoice|order no|serial|total|chapter|section|figure|\\bpp?\\.|page|build|release|commit|sha|md5|checksum|uuid"
CONTEXT = 40
LABELERS = ("shape", "check", "gazetteer", "context", "border")
#: What the classifier sees besides the votes, each in a few steps: length, share of digits, different characters, the sign before the span.
TRAITS = {"long": 4, "digits": 4, "variety": 3, "after": 4}
SURE = 0.9
ROUNDS = 50
#: Matches of a text that are placed together; the work grows with a text's matches times this, not with their square.
TOGETHER = 128

Span = "array<struct<start:int,stop:int,s:string,before:string,next:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """(start, stop, s, before, next) of the leftmost matches that don't overlap, in code points, with the text right before and the character after.

    The pieces between the matches and the matches themselves add up to the offsets: first inside groups of
    matches, then over the groups. `before` doesn't reach over an earlier match.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"), F.split(text, pattern, -1).alias("g"))

    def piece(m: Column, k: Column, g: Column) -> Column:
        own = F.get(g, k)
        return F.struct(F.length(own).alias("gap"), F.length(m).alias("size"), m.alias("s"), F.right(own, F.lit(CONTEXT)).alias("before"), F.substring(F.get(g, k + 1), 1, 1).alias("next"))

    def placed(x: Column) -> Column:
        pieces = F.transform(x["m"], lambda m, k: piece(m, k, x["g"]))
        return _let(pieces, lambda p: _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / TOGETHER).cast("int")), lambda c: inside(F.slice(p, c * TOGETHER + 1, F.lit(TOGETHER)))), over))

    def inside(group: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            stop = begin + p["size"]
            span = F.struct(begin.alias("start"), stop.alias("stop"), p["s"].alias("s"), p["before"].alias("before"), p["next"].alias("next"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(group, F.struct(F.lit(0).alias("at"), F.array().cast(Span).alias("out")), step)

    def over(groups: Column) -> Column:
        def step(acc: Column, g: Column) -> Column:
            return F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        shifts = F.aggregate(groups, first, step, lambda acc: acc["out"])
        moved = lambda g, by: F.transform(g["out"], lambda v: F.struct((v["start"] + by).alias("start"), (v["stop"] + by).alias("stop"), v["s"].alias("s"), v["before"].alias("before"), v["next"].alias("next")))
        return F.flatten(F.zip_with(groups, shifts, moved))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(both, placed)).otherwise(F.array().cast(Span))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def octets(s: Column) -> Column:
    """Whether all parts are at most 255, leading zeros aside."""
    parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def meets_rule(kind: str, s: Column) -> Column:
    """The base rule of a kind, for a match of its base pattern."""
    if kind == "ip":
        return octets(s)
    n = F.length(digits(s))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _vote(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _distinct(s: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.lower(s), "")))


def _votes(kind: str, wide: bool, x: Column) -> dict[str, Column]:
    """1 for, 0 against, -1 no opinion, of each labeler; no labeler sees another's evidence."""
    s, number = x["s"], digits(x["s"])
    n = F.length(number)
    begins = lambda codes: F.regexp_like(number, F.lit(f"^0*(?:{'|'.join(codes)})"))
    says = lambda pattern: _vote(F.regexp_like(s, F.lit(pattern)))
    shape = {
        "email": says(r"^[A-Za-z0-9].*[A-Za-z]{2,}$"),
        "ip": says(r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})){3}$") if not wide else says(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|::"),
        "card": says(r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"),
        "phone": _vote(n.between(9, 13) & F.regexp_like(s, F.lit(r"[\x20().-]"))),
        "secret": says(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,}|(?:sk|pk|ghp|xox[a-z])[-_].+|AKIA[0-9A-Z]{16})$"),
    }[kind]
    check = {
        "email": _vote(~F.regexp_like(s, F.lit(r"\.\.|^[.-]|[.-]$"))),
        "ip": _vote(octets(s)) if not wide else _vote(F.size(F.split(s, ":")) <= 8),
        "card": _vote(meets_rule("card", s)),
        "phone": _vote(meets_rule("phone", s)),
        "secret": _vote(_distinct(s) >= 10),
    }[kind]
    near = F.lower(x["before"])
    known = {
        "email": _vote(F.regexp_like(F.lower(s), F.lit(rf"(?:{'|'.join(ENDINGS)})$"))),
        "ip": F.when(F.regexp_like(s, F.lit(r"^(?:0|127|255)\.")), 0).otherwise(-1),
        "card": _vote(begins(ISSUERS)),
        "phone": F.lit(-1) if wide else _vote(begins(CODES)),
        "secret": F.when(F.regexp_like(near, F.lit(NAMED)), 1).otherwise(-1),
    }[kind]
    context = F.when(F.regexp_like(near, F.lit(AGAINST)), 0).when(F.regexp_like(near, F.lit(CUES[kind])), 1).otherwise(-1)
    glued = F.regexp_like(x["before"], F.lit(r"[A-Za-z0-9_/\\-]$")) | F.regexp_like(F.coalesce(x["next"], F.lit("")), F.lit(r"[A-Za-z0-9_/\\-]"))
    border = F.when(glued, 0).when(F.regexp_like(x["before"], F.lit(r"[\"'=:(<\[]\x20?$")), 1).otherwise(-1)
    return dict(zip(LABELERS, (shape, check, known, context, border), strict=True))


def _traits(x: Column) -> dict[str, Column]:
    """The span's make-up, each from 0 to less than its number of steps."""
    size = F.length(x["s"])
    share = F.length(digits(x["s"])) / F.greatest(size, F.lit(1))
    last = F.right(x["before"], F.lit(1))
    steps = lambda value, *ends: sum((F.when(value >= e, 1).otherwise(0) for e in ends), F.lit(0))
    sign = F.when(last == "", 0).when(F.regexp_like(last, F.lit(r"\s")), 1).when(F.regexp_like(last, F.lit(r"[\"'=:(]")), 2).otherwise(3)
    return {"long": steps(size, 12, 20, 33), "digits": steps(share, 0.2, 0.5, 0.9), "variety": steps(_distinct(x["s"]), 6, 10), "after": sign}


def _judge(kind: str, wide: bool) -> Callable[[Column], Column]:
    """Of a span: whether it meets the base rule, the labelers' votes and its traits."""

    def judged(x: Column) -> Column:
        base = F.lit(False) if wide else meets_rule(kind, x["s"])
        seen = [v.cast("int").alias(n) for n, v in (_votes(kind, wide, x) | _traits(x)).items()]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), base.alias("base"), *seen)

    return judged


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): all candidate spans of each row with base, the labelers' votes, traits and kind, in no order."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    found = []
    for kind in KINDS:
        for wide, patterns in ((False, BASE), (True, WIDE)):
            if kind not in patterns:
                continue
            spans = matches(t, patterns[kind])
            if (kind, wide) in NEEDS:
                spans = F.when(F.contains(t, F.lit(NEEDS[kind, wide])), spans).otherwise(F.array().cast(Span))
            found.append(F.transform(spans, _judge(kind, wide)))
    return rows.select("doc_id", F.concat(*found).alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier: of each kind, of each labeler's vote against and for, and of each step of each trait; and the estimated reliabilities."""

    bias: tuple[float, ...]
    against: tuple[float, ...]
    favour: tuple[float, ...]
    traits: tuple[tuple[float, ...], ...]
    reliability: tuple[float, ...]

    def chance(self, span: Column) -> Column:
        z = F.get(F.array(*map(F.lit, self.bias)), span["kind"])
        for name, no, yes in zip(LABELERS, self.against, self.favour, strict=True):
            z = z + F.when(span[name] == 1, yes).when(span[name] == 0, no).otherwise(0.0)
        for name, weights in zip(TRAITS, self.traits, strict=True):
            z = z + F.get(F.array(*map(F.lit, weights)), span[name])
        return 1 / (1 + F.exp(-z))


def expectations(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chance that each vote pattern is a true span, by expectation-maximisation, with each kind's share of true spans and each labeler's chances of a vote for, given a true and a false span.

    Labelers err independently of each other given the truth; an abstention says nothing. The shares and
    chances are drawn a little to their first guesses, as if some spans had been seen already.
    """
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    share = np.full(len(KINDS), 0.5)
    true, false = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2)
    for _ in range(rounds):
        z = np.log(share[kind] / (1 - share[kind])) + yes @ np.log(true / false) + no @ np.log((1 - true) / (1 - false))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = (n[own] @ p[own] + 1) / (n[own].sum() + 2)
        true = ((n * p) @ yes + 8) / ((n * p) @ (yes + no) + 10)
        false = ((n * (1 - p)) @ yes + 2) / ((n * (1 - p)) @ (yes + no) + 10)
        true, false = np.clip(true, 0.02, 0.98), np.clip(false, 0.02, 0.98)
    return p, share, true, false


def fit(patterns: list[tuple], rounds: int = ROUNDS) -> SpanModel:
    """Learn from (kind, votes..., traits..., count) rows, of which there are few however many spans there are.

    The estimated chances of `expectations` are what a logistic regression over kinds, votes and traits learns,
    by Newton's method. No patterns give a model that is sure of nothing.
    """
    kinds, many = len(KINDS), len(LABELERS)
    steps = list(TRAITS.values())
    if not patterns:
        return SpanModel((-9.0,) * kinds, (0.0,) * many, (0.0,) * many, tuple((0.0,) * k for k in steps), (0.5,) * many)
    rows = np.array(sorted(patterns), float)
    kind, votes, traits, n = rows[:, 0].astype(int), rows[:, 1 : 1 + many], rows[:, 1 + many : -1].astype(int), rows[:, -1]
    p, share, true, false = expectations(kind, votes, n, rounds)
    x = np.concatenate([np.eye(kinds)[kind], votes == 0, votes == 1, *(np.eye(k)[traits[:, j]] for j, k in enumerate(steps))], axis=1).astype(float)
    weight = np.sqrt(n)  # frequent patterns count more, but don't drown the rest
    # The ridge draws to the log odds of the estimated reliabilities, which stand for votes that no span has.
    middle = np.concatenate([np.log(share / (1 - share)), np.log((1 - true) / (1 - false)), np.log(true / false), np.zeros(sum(steps))])
    w = middle.copy()
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - q)) - 0.05 * (w - middle)
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w)), gradient)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    bias, against, favour, *own = (tuple(part.tolist()) for part in np.split(w, np.cumsum([kinds, many, many, *steps])[:-1]))
    return SpanModel(bias, against, favour, tuple(own), tuple(((true + 1 - false) / 2).tolist()))


def train(found: DataFrame) -> SpanModel:
    """Learn from all candidates of the corpus; only counts of patterns reach the driver, of which there are 5 x 3^5 x 192 at most."""
    names = ["kind", *LABELERS, *TRAITS]
    span = found.select(F.explode("spans").alias("x")).select(*[f"x.{n}" for n in names])
    return fit([tuple(r) for r in span.groupBy(*names).count().collect()])


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, base and spans, arrays of (kind, start, stop) in order of kind, then start.

    base has the spans that meet the base rules; spans has those and the ones that the classifier adds,
    which overlap with no base span. Offsets count code points; stop is exclusive. Null texts are empty;
    repeated rows are each searched; an empty table gives none. No shuffle but of pattern counts.
    """
    found = checkpointed(candidates(docs, doc_id, text))
    model = train(found)
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    base = found.withColumn("base", F.array_sort(F.transform(F.filter("spans", lambda x: x["base"]), bare)))
    sure = base.withColumn("sure", F.transform(F.filter("spans", lambda x: ~x["base"] & (model.chance(x) >= SURE)), bare))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    added = F.when(F.size("sure") > 0, F.array_distinct(F.filter("sure", free))).otherwise(F.col("sure"))
    return sure.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
