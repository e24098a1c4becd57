"""Phrase collocations, counted on a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation and pieces into words. Words that occur
less often than a phrase must are in no phrase, so pieces are parted at them
too. What is left is parsed: a word whose hash is divisible by ``TRIGGER`` opens
a chunk, which runs on over the first ``LONGEST - 1`` words of the next one.
Equal chunks are equal wherever they stand, and form a dictionary with their
frequencies; copies of texts and common passages are in it once. Phrases are
then counted inside the dictionary's chunks, weighted by frequency. A phrase
belongs to the chunk that owns its first word, the part before the overlap, so
each occurrence counts once.

Phrases of two words come first; only where each two words in a row are frequent
are three and four counted. Both cuts of what is counted use Bloom filters of at
most ``FILTER_BITS``: they let some phrases through that are dropped later, and
leave none out. Counting, chunks and phrases are sums by key, combined before
each shuffle. The parts of candidates are looked up by joins in which common
parts are salted, and the best of each language are taken within salted shares
first.

Defined results: a null or empty text has no words; a null language is
``und``; repeated rows count each; texts are read whole, in parts of about
``PART_BYTES`` cut at punctuation; ties of a cut go to the shorter first part,
ties of rank to the larger count and then to the smaller phrase in byte order;
an empty table gives an empty result; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bloom import Level, build, mixed, passes
from tidemark.operators.skew import join_per_key
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one around it has this share of its count, in hundredths.
SHARE = 80
TRIGGER = 8
FILTER_RATE, FILTER_BITS = 0.02, 1 << 25
PART_BYTES = 1 << 20
#: Shares in which the best of a language are sought first.
SALTS = 64

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BREAK = re.compile(r"[.,;:!?\x0A-\x0D]")


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART_BYTES``, cut after a character that parts pieces."""
    at = 0
    while len(text) - at > PART_BYTES:
        found = _BREAK.search(text, at + PART_BYTES)
        if found is None:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def _slices(rows: Iterator[tuple]) -> Iterator[tuple[list[str], list[tuple]]]:
    """Parts of texts, the first of each row, about ``PART_BYTES`` at a time, with the rest of their rows."""
    texts, others, held = [], [], 0
    for text, *rest in rows:
        for part in _parts(text):
            texts.append(part)
            others.append(rest)
            held += len(part)
            if held >= PART_BYTES:
                yield texts, others
                texts, others, held = [], [], 0
    if texts:
        yield texts, others


@dataclass(frozen=True)
class Words:
    """All words of some texts: spellings (``data`` holds them parted by spaces), codes of equal ones, and where each stands."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    code: np.ndarray
    spellings: pa.Array
    text: np.ndarray
    piece: np.ndarray
    #: The first word of each text, and the number of all.
    bound: np.ndarray

    def spelled(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The words from each ``begin`` up to each ``end``, space-joined."""
        lo = self.start[begin]
        size = self.start[end - 1] + self.length[end - 1] - lo
        offsets = np.concatenate(([0], np.cumsum(size)))
        places = np.repeat((lo - offsets[:-1]).astype(np.int32), size)
        places += np.arange(offsets[-1], dtype=np.int32)
        return _strings(offsets, self.data[places])


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def cut_words(texts: list[str]) -> Words:
    """Words of texts, A-Z lower-cased; a line feed after each text parts pieces."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in encoded])
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    kind = _KIND[low]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    length = end - begin
    start = np.cumsum(length + 1) - (length + 1)
    alone = _strings(np.concatenate(([0], np.cumsum(length))), low[word]).dictionary_encode()
    # a word's bytes and one more, which becomes the space between it and the next
    low = np.where(word, low, np.uint8(0x20))
    word[end] = True
    data = low[word]
    bound = np.concatenate(([0], np.searchsorted(begin, ends)))
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
    return Words(data, start, length, alone.indices.to_numpy(), alone.dictionary, np.repeat(np.arange(len(texts)), np.diff(bound)), piece, bound)


def _hashed(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _word_hashes(lang: pa.Array, lang_code: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of (language, word), given the words'."""
    with np.errstate(over="ignore"):
        return mixed(_hashed(lang), 1)[lang_code] + hashes


def _pair_hash(h: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h, 9) + after


def _known(h: np.ndarray, level: Level) -> np.ndarray:
    return passes(h, mixed(h, 77), 0, level)


def _coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of the distinct values of ``key``, and a place of each."""
    code, found = pd.factorize(key)
    place = np.empty(len(found), dtype=np.int64)
    place[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, place


def _grouped(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value of ``key``, and the sums of their weights."""
    code, place = _coded(key)
    if weight.sum(dtype=float) < 2**52:
        return place, np.bincount(code, weights=weight, minlength=len(place)).astype(np.int64)
    # sums of integers beyond 2^53 would not be exact in floating point
    total = np.zeros(len(place), dtype=np.int64)
    np.add.at(total, code, weight)
    return place, total


def _languages(rest: list[tuple]) -> tuple[np.ndarray, pa.Array]:
    code, found = pd.factorize(np.array([r[0] for r in rest], dtype=object))
    return code, pa.array(found, pa.string())


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(k).to_pylist() for k in range(b.num_columns)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for texts, rest in _slices(_rows(b)):
            w, (lang, langs) = cut_words(texts), _languages(rest)
            of = lang[w.text]
            place, n = _grouped(of.astype(np.int64) * (len(w.spellings) + 1) + w.code, np.ones(len(w.code), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of[place])), w.spellings.take(pa.array(w.code[place])).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "f"])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(found: DataFrame, words: int) -> Level:
    """A filter of the phrases of ``found(lang, phrase)``, of one word or of two."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column("lang").dictionary_encode()
            sides = [list(x) for x in zip(*(p.split(" ") for p in b.column("phrase").to_pylist()))] or [[]] * words
            each = [_word_hashes(lang.dictionary, lang.indices.to_numpy(), _hashed(pa.array(s, pa.large_string()))) for s in sides]
            h = each[0] if words == 1 else _pair_hash(*each)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, mixed(h, 77))], names=["a", "b"])

    return build(found.select("lang", "phrase").mapInArrow(hashes, "a long, b long"), 0, found.count(), FILTER_RATE, FILTER_BITS)


def parse(texts: DataFrame, frequent: Level) -> DataFrame:
    """``(lang, chunk, owned, n)``: the distinct chunks of ``texts(text, lang)``, how many words each owns, and its frequency."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rest in _slices(_rows(b)):
                w, (lang, langs) = cut_words(part), _languages(rest)
                of = lang[w.text]
                hashes = _hashed(w.spellings)
                which, place = _coded(of.astype(np.int64) * (len(w.spellings) + 1) + w.code)
                alive = np.flatnonzero(_known(_word_hashes(langs, of[place], hashes[w.code[place]]), shared.value)[which])
                if len(alive) < 2:
                    continue
                opens = (mixed(hashes, 5) % np.uint64(TRIGGER) == 0)[w.code[alive]]
                # a stretch: frequent words in a row, within one piece
                new = np.concatenate(([True], (np.diff(alive) != 1) | (np.diff(w.piece[alive]) != 0)))
                stretch = np.cumsum(new) - 1
                stretch_end = np.append(np.flatnonzero(new)[1:], len(alive))
                first = np.flatnonzero(new | opens)
                last = np.minimum(np.append(first[1:], len(alive)), stretch_end[stretch[first]])
                end = np.minimum(last + LONGEST - 1, stretch_end[stretch[first]])
                kept = end - first > 1
                first, owned, end = first[kept], (last - first)[kept], end[kept]
                if not len(first):
                    continue
                chunk = w.spelled(alive[first], alive[end - 1] + 1).dictionary_encode()
                code, of_chunk = chunk.indices.to_numpy(), of[alive[first]]
                spelled, _ = _coded(of_chunk.astype(np.int64) * (len(chunk.dictionary) + 1) + code)
                place, n = _grouped(spelled * (int(owned.max()) + 1) + owned, np.ones(len(code), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of_chunk[place])), chunk.dictionary.take(pa.array(code[place])).cast(pa.string()), pa.array(owned[place].astype(np.int32)), pa.array(n)],
                    names=["lang", "chunk", "owned", "n"],
                )

    found = texts.mapInArrow(chunks, "lang string, chunk string, owned int, n long")
    return found.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


def phrases_in(dictionary: DataFrame, pairs: Level | None = None) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases of two words, or, with a filter of these, of three and more."""
    shared = dictionary.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rest in _slices(_rows(b)):
                w, (lang, langs) = cut_words(part), _languages(rest)
                owned, weight = (np.array([r[k] for r in rest], dtype=np.int64) for k in (1, 2))
                total = len(w.code)
                at = np.arange(total)
                left = w.bound[1:][w.text] - at
                mine = at - w.bound[:-1][w.text] < owned[w.text]
                of = lang[w.text]
                which, place = _coded(of.astype(np.int64) * (len(w.spellings) + 1) + w.code)
                two = np.flatnonzero(left >= 2)
                pair, first = _coded(which[two].astype(np.int64) * (len(place) + 1) + which[two + 1])
                number = np.full(total + LONGEST, -1, dtype=np.int64)
                if shared.value is None:
                    number[two] = pair
                    begin = np.flatnonzero(mine & (left >= 2))
                    counted = [(2, begin, number[begin])]
                else:
                    h = _word_hashes(langs, of[place], _hashed(w.spellings)[w.code[place]])
                    good = _known(_pair_hash(h[which[two[first]]], h[which[two[first] + 1]]), shared.value)
                    number[two] = np.where(good[pair], pair, -1)
                    reach, counted = mine & (number[:total] >= 0), []
                    for n in range(3, LONGEST + 1):
                        # n - 1 pairs in a row; the first, the last and those between tell the words
                        reach = reach & (left >= n) & (number[n - 2:total + n - 2] >= 0)
                        begin = np.flatnonzero(reach)
                        key = number[begin]
                        for k in range(2, n - 2, 2):
                            key = _coded(key * (len(first) + 1) + number[begin + k])[0]
                        counted.append((n, begin, _coded(key)[0] * (len(first) + 1) + number[begin + n - 2]))
                for n, begin, key in counted:
                    if not len(begin):
                        continue
                    place, f = _grouped(key, weight[w.text[begin]])
                    begin = begin[place]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(of[begin])), w.spelled(begin, begin + n).cast(pa.string()), pa.array(f)], names=["lang", "phrase", "f"])

    return _summed(dictionary.select("chunk", "lang", "owned", "n").mapInArrow(count, "lang string, phrase string, f long")).filter(F.col("f") >= LEAST)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all phrases of 1 to ``LONGEST`` words with ``f`` of ``LEAST`` and more, and ``(lang, n)``, the words of each language."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, text, lang)
    words = materialize(_summed(texts.mapInArrow(_count_words, "lang string, phrase string, f long")), "words")
    sizes = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    one = materialize(words.filter(F.col("f") >= LEAST), "phrases")
    release(words)
    dictionary = materialize(parse(texts, _filter(one, 1)), "chunks")
    two = materialize(phrases_in(dictionary), "phrases")
    more = materialize(phrases_in(dictionary, _filter(two, 2)), "phrases")
    release(dictionary)
    return one.unionByName(two).unionByName(more), sizes


def _looked_up(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``rows[key]`` as ``name``; common phrases are salted."""
    asked = rows.groupBy("lang", key).agg(F.count("*").alias("_rows"))
    single = asked.join(counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)), ["lang", key])
    return join_per_key(rows, single, ["lang", key], "_rows", rows.count(), "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``."""
    counts, sizes = frequent_phrases(docs, text, lang)
    parts = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    candidates = counts.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), parts.alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: joined(s, m))))
    around = candidates.filter(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SHARE))
    k = F.col("k")
    cuts = materialize(
        kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", joined(1, k).alias("first"), joined(k + 1, F.size("w")).alias("rest")),
        "cuts",
    )
    with_first = materialize(_looked_up(cuts, counts, "first", "l"), "cuts")
    both = _looked_up(with_first, counts, "rest", "r")
    scored = both.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = materialize(lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "scored")
    release(cuts, with_first)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    ahead = flat.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    best = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
s AS (SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)),
x AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM s GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
k AS (SELECT *, unnest(range(1, m)) AS k FROM d),
t AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score FROM k
      JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ')
      JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""
