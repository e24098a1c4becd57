"""Token counts and ids with a public word tokenizer, by the whole-token shortcut.

The vocabulary strings that the tokenizer encodes alone as one token are found
once, on the driver, by encoding each of them; a pre-token that is such a
string is that token. Only other pre-tokens are merged, by the library's model.
A pre-token has the same tokens wherever it stands, so workers keep what they
have merged: strings of up to ``CACHED_CHARS`` characters, within ``CACHE_ENTRIES``
and ``CACHE_BYTES``, and then they start over.

Texts that hold a special token's string go to the library whole. So do
stretches without white space that have characters beyond ASCII and Latin-1
letters; the tokenizer never joins text over white space.

Defined results: a null text is an empty one; texts of any length are counted
whole; repeated rows are counted each; an empty table gives an empty result;
columns named ``n_bytes``, ``n_tokens`` and ``over_limit`` are replaced, and all
others stay, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.shipping import ship_package

#: Bounds of a worker's cache of merged strings, and the longest string that it keeps.
CACHE_ENTRIES, CACHE_BYTES, CACHED_CHARS = 300_000, 32 << 20, 256
#: Characters of text that are split at a time.
SLICE_CHARS = 1 << 20
TOKEN_LIMIT = 2048
LATIN = "a-zß-öø-ÿ"
SIMPLE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SPACES = re.compile(r"[\t-\r ]+")
#: The tokenizer's own pattern, for simple lower-case text; letters first, which no other branch starts with.
PRE_TOKEN = re.compile(rf"[{LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LATIN}0-9]+")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest count from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def tokenizer_spec(path: str) -> tuple[str, dict[str, int]]:
    """The tokenizer file's text, and the strings proved to encode alone as one token with that token's id."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    end = spec["model"].get("end_of_word_suffix") or ""
    letters, words = _byte_letters(), {}
    for token, at in spec["model"]["vocab"].items():
        if token.endswith(end):
            stem = token[: len(token) - len(end)] if end else token
            try:
                words[bytes(letters[c] for c in stem).decode()] = at
            except (KeyError, UnicodeDecodeError):
                continue
    coder = Tokenizer.from_str(text)
    coder.encode_special_tokens = True
    strings = [w for w in words if w]
    found = coder.encode_batch(strings, add_special_tokens=False)
    return text, {w: words[w] for w, e in zip(strings, found, strict=True) if e.ids == [words[w]]}


class Coder:
    """Encodes texts in one worker."""

    def __init__(self, spec: str, whole: dict[str, int]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.plain = Tokenizer.from_str(spec)
        self.plain.encode_special_tokens = True
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.whole = {w: struct.pack("<I", i) for w, i in whole.items()}
        self.known, self.held = dict(self.whole), 0

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pre_tokens(self, text: str) -> list[str]:
        """Keys of ``known``; a stretch that is not simple is one key, marked by a space."""
        if SIMPLE.fullmatch(text):
            return PRE_TOKEN.findall(text.lower())
        out: list[str] = []
        for stretch in SPACES.split(text):
            if SIMPLE.fullmatch(stretch):
                out += PRE_TOKEN.findall(stretch.lower())
            else:
                out.append(" " + stretch)
        return out

    def _learn(self, new: Iterable[str]) -> None:
        merge, known, letters = self.plain.model.tokenize, self.known, self.letters
        for key in new:
            if key[0] == " ":
                known[key] = self._packed(self.plain.encode(key[1:], add_special_tokens=False).ids)
            else:
                spelled = key if key.isascii() else key.encode().decode("latin-1").translate(letters)
                known[key] = self._packed([t.id for t in merge(spelled)])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        held: list[tuple[list[str] | None, str]] = []
        size = 0
        for text in texts:
            text = text or ""
            special = "<" in text and any(s in text for s in self.specials)
            held.append((None if special else self._pre_tokens(text), text))
            size += len(text)
            if size >= SLICE_CHARS:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[list[str] | None, str]]) -> Iterator[bytes]:
        seen = set().union(*(x for x, _ in held if x))
        new = seen.difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES + len(self.whole) or self.held > CACHE_BYTES:
            self.known, self.held = dict(self.whole), 0
            new = seen.difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        for parts, text in held:
            if parts is None:
                yield self._packed(self.library.encode(text, add_special_tokens=False).ids)
            else:
                yield b"".join(map(get, parts))
        for key in new:
            if len(key) > CACHED_CHARS:
                del self.known[key]
            else:
                self.held += len(key) + len(self.known[key])


_CODERS: dict[int, Coder] = {}


def coder(shared) -> Coder:
    """The worker's coder for a broadcast ``tokenizer_spec``; one stays from task to task."""
    spec, whole = shared.value
    key = zlib.crc32(spec.encode())
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(spec, whole)
    return _CODERS[key]


def share_tokenizer(spark, path: str):
    """The vocabulary, a file of fixed size, for all executors."""
    ship_package(spark)
    return spark.sparkContext.broadcast(tokenizer_spec(path))


def word_tokenizer() -> str:
    """Where the default tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    shared = share_tokenizer(docs.sparkSession, path or word_tokenizer())
    fields = [*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(x) // 4 for x in own.encode(texts)]
            sizes = [len((t or "").encode()) for t in texts]
            added = [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, T.StructType(fields))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
