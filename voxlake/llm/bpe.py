"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A word's byte-pair encoding ends, for each of its prefixes, in one token that is fixed by the prefix alone.
An automaton reports all vocabulary entries that are a suffix of the prefix; the one token whose pair with
the last token of the remaining prefix survives the merges is stored, and following the stored tokens
backwards from the whole word gives the exact ids, without replaying the merge loop.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: Stands for the end-of-word suffix inside this module; it is no byte-level character.
END = ""
#: Words whose encoding a Python worker remembers; the memory of a worker is bounded by it.
CACHED_WORDS = 80_000
CACHED_PAIRS = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(spare)}


class Remembered(dict):
    """Results of a function by key, in two generations: what is in use outlives a full table."""

    def __init__(self, make, bound: int = CACHED_WORDS):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if isinstance(key, str) and len(key) >= 64:
            return found
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class PrefixEncoder:
    """Exact ids of words under a merge table that marks the ends of words."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        vocab = {self._own(t): i for t, i in model["vocab"].items()}
        size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.strings = [""] * size
        for t, i in model["vocab"].items():
            self.strings[i] = t
        self.length = [0] * size
        #: Rank of the merge that makes a token, and its two parts; symbols have rank -1.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        for t, i in vocab.items():
            self.length[i] = len(t)
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[self._own(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = vocab[self._own(self.strings[a] + self.strings[b])]
            self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
            self.merge[a << 20 | b] = rank
        self.matches = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self._reachable(i):
                self.matches.add_word(t, (i, len(t)))
        self.matches.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            self.strings[i] = content
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Text of Latin letters alone is in NFC, and no version of Unicode changes its classes; U+001C to U+001F
        # are white space to Python's split only.
        self.odd = regex.compile("[^\\x00-\\x1b\\x20-\\u024f]").search
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+").findall
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.pairs = Remembered(lambda key: self._untouched(key >> 20, key & 0xFFFFF, float("inf")), CACHED_PAIRS)
        packed = lambda ids: array("i", ids).tobytes()
        self.ids_of_word = Remembered(self.encode_word)
        self.ids_of_chunk = Remembered(lambda x: packed(self.encode_chunk(x)))
        self.ids_of_symbols = Remembered(lambda x: packed(self.encode_symbols(x)))
        self.special_ids = Remembered(lambda x: packed([self.special[x]]))

    def _own(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if token.endswith(self.suffix) and len(token) > len(self.suffix) else token

    def _untouched(self, a: int, b: int, before: float) -> bool:
        """Whether no merge with a rank below `before` joins the end of token a to the start of token b.

        Both tokens are taken apart from the latest merge back; at each state of the border, the merge of
        the two tokens that meet there must come later than the merge that ended this state.
        """
        rank, merge = self.rank, self.merge
        while True:
            across = merge.get(a << 20 | b)
            if across is not None and across < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = min(before, ra), self.right[a]
            else:  # equal merges run from the left, so one across the border comes before that in b
                before, b = min(before, rb + 1), self.left[b]

    def _reachable(self, token: int) -> bool:
        return self.rank[token] < 0 or self._untouched(self.left[token], self.right[token], self.rank[token])

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of the two tokens side by side is encoded as just these."""
        return self.pairs[a << 20 | b]

    def encode_symbols(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in byte-level characters."""
        word += END
        size = len(word)
        last = [-1] * (size + 1)
        pairs = self.pairs
        for at, (token, n) in self.matches.iter(word):
            at += 1
            if last[at] < 0:
                before = at - n
                if not before or (b := last[before]) >= 0 and pairs[b << 20 | token]:
                    last[at] = token
        length, out = self.length, []
        while size:
            out.append(token := last[size])
            size -= length[token]
        return tuple(out[::-1])

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token of Latin text."""
        return self.encode_symbols(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet))

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of lower-case Latin text between white space."""
        if chunk.isalpha():
            return self.encode_word(chunk)
        known = self.ids_of_word
        return tuple([i for word in self.words(chunk) for i in known[word]])

    def spans(self, text: str) -> Iterator[tuple[list[str], Remembered]]:
        """Pieces of a text, in order, and the table that holds their packed ids."""
        for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
            if part in self.special:
                yield [part], self.special_ids
            elif self.odd(part):
                mapped = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
                yield [x for x, _ in mapped], self.ids_of_symbols
            else:
                yield part.lower().split(), self.ids_of_chunk

    def packed(self, text: str) -> memoryview:
        """Ids of a text as 32-bit integers."""
        return memoryview(b"".join([b"".join(map(ids.__getitem__, pieces)) for pieces, ids in self.spans(text)])).cast("i")

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder: tokens are joined by spaces and keep their end-of-word marks."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each Python worker."""
    return PrefixEncoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, text: str, names: list[str], both: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in sliced(batches):
        flat, ends, decoded = [], [0], []
        for value in batch.column(text).to_pylist():
            flat.append(packed := own.packed(value or ""))
            ends.append(ends[-1] + len(packed))
            if both:
                decoded.append(own.decode(packed))
        values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(flat))])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([*batch.columns, ids] + ([pa.array(decoded, pa.string())] if both else []), names=names)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the token ids of each whole text, and on request with the ids decoded again.

    Equal to the tokenizers library with add_special_tokens=False. A null or empty text has no ids; the
    strings of special tokens in a text become those tokens, as in the library. Repeated rows are each
    encoded. Columns that have the names asked for are replaced; all others pass through.
    One narrow stage: no shuffle, a bounded cache of words in each worker, and nothing of the text is cut.
    """
    kept = docs.select([c for c in docs.columns if c.lower() not in {ids.lower(), (decoded or ids).lower()} or c == text])
    fields = [*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    schema = T.StructType(fields)
    run = partial(_encode, path=tokenizer, text=text, names=schema.names, both=decoded is not None)
    return kept.mapInArrow(run, schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in sliced(batches):
        known = range(len(own.strings))
        texts = [own.decode(i for i in x or () if i is not None and i in known) for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids, as the library's decode(ids, skip_special_tokens=False).

    Null ids count as none; ids that the vocabulary lacks are skipped. A column with the name asked for is replaced.
    """
    kept = encoded.select([c for c in encoded.columns if c.lower() != decoded.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])
    return kept.mapInArrow(partial(_decode, path=tokenizer, ids=ids, names=schema.names), schema)


def ids_digest(ids: str = "ids") -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


