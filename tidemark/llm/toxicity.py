"""Toxicity scores: bags of character n-grams, embedded, averaged and given to a linear softmax.

A word is a run of characters other than white space and punctuation; its
n-grams of 3 to 5 characters, its two ends marked, are hashed into ``BUCKETS``.
The n-grams of ``WINDOW`` words in a row make one bag. A bag's vector is the
mean of its n-grams' vectors, and the softmax over it tells how toxic the
window is; a text is as toxic as its worst window, so a few words count in a
text of any length. Vectors and softmax are trained together in numpy, first on
whole texts and then through their worst windows. An unseen misspelling shares
most of its n-grams with the word meant, and so their vectors.

Training uses at most ``SAMPLE_ROWS`` labelled rows, half of either class where
there are so many, those with the smallest hashes of their ids; the two classes'
shares among all labelled rows are then put back into the bias. Only
n-grams that toxic texts hold clearly more often have a vector, at most
``FEATURES``, and all others count in the mean as zero. A word that a window
repeats adds its vectors once, so that one word said often is one word. Tasks count and cut; what
reaches the driver is bounded by these parameters, and by ``SAMPLE_HITS``
n-grams at most in all sampled windows. Scoring is one pass without a shuffle.

Defined results: a null or empty text has the score of an empty bag; a row
without an id is scored and, like every id whose crc32 is divisible by 5, held
out; rows that repeat are scored each, and of differing texts under one id the
smallest is learned; an id labelled both ways counts as toxic; a null label is
none; without labels of both classes all scores are the share of toxic ones
(0 without any); texts are read whole, in parts of ``PART_CHARS`` characters cut
at white space where there is any; an empty table gives an empty result;
columns named ``held_out``, ``score`` and ``predicted`` are replaced, and all
others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
WINDOW = 48
#: Bounds of the training sample: rows, n-grams with a vector, and their places in all sampled windows.
SAMPLE_ROWS, FEATURES, SAMPLE_HITS = 6144, 4096, 8_000_000
#: An n-gram has a vector if so many sampled texts hold it, and toxic ones more often than clean ones by so many standard errors.
LEAST_TEXTS, LEAST_DEVIATE = 5, 5.0
DIMENSIONS, STEPS, RATE, DECAY = 8, 120, 0.1, 1e-5
#: What the mean is multiplied by, so that vectors of common size can tell windows apart, and the zero vectors that every mean includes, so that a last window of a word or two weighs little.
GAIN, PADDING = 50.0, 300
FOLDS = 5
PART_CHARS = 1 << 19

_PARTING = np.zeros(256, dtype=bool)
_PARTING[[*range(33), *map(ord, ".,;:!?|\"()[]{}<>/\\"), 0x7F, 0x85, 0xA0, 0xAB, 0xBB, 0xBF]] = True


def _parting(points: np.ndarray) -> np.ndarray:
    wide = ((points >= 0x2000) & (points <= 0x206F)) | (points == 0x3000)
    return _PARTING[np.minimum(points, 255)] & (points < 256) | wide


@dataclass(frozen=True)
class Bags:
    """N-grams of windows: a bucket, a window and a hash of the word for each, a text for each window."""

    bucket: np.ndarray
    window: np.ndarray
    word: np.ndarray
    text: np.ndarray


def bags(texts: list[str], width: int = WINDOW) -> Bags:
    """The n-grams of all windows of ``width`` words, in the order of texts and words."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    parting = _parting(points)
    kept = np.flatnonzero(~np.concatenate(([False], parting[1:] & parting[:-1])))
    s = np.where(parting, np.uint32(0), points)[kept]
    starts = np.flatnonzero((s[:-1] == 0) & (s[1:] != 0))
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return Bags(none, none, none, none)
    of_word = np.searchsorted(np.cumsum(sizes), kept[starts + 1], side="left")
    first = np.searchsorted(of_word, of_word, side="left")
    opens = (np.arange(len(starts)) - first) % width == 0
    window_of_word = np.cumsum(opens) - 1
    at = np.zeros(len(s), dtype=np.int32)
    at[starts] = 1
    word = np.cumsum(at, dtype=np.int32) - 1
    inner, bucket, window, word_hash = s != 0, [], [], []
    with np.errstate(over="ignore"):
        # a word's characters, each mixed with its place
        place = np.arange(len(s), dtype=np.uint32) - starts.astype(np.uint32)[np.maximum(word, 0)]
        hashed = (s * np.uint32(0x9E3779B1) ^ place * np.uint32(0x85EBCA6B)).astype(np.uint64)
        hashed = (hashed ^ (hashed >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
        signature = np.add.reduceat(np.where(inner, hashed, np.uint64(0)), starts).view(np.int64)
        for n in ORDERS:
            if len(s) < n:
                continue
            ends = len(s) - n + 1
            valid = inner[1:ends + 1].copy()
            h = np.full(ends, n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + s[k:ends + k]
                if 1 < k < n - 1:
                    valid &= inner[k:ends + k]
            here = np.flatnonzero(valid)
            h = h[here]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            bucket.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
            window.append(window_of_word[word[here]])
            word_hash.append(signature[word[here]])
    return Bags(np.concatenate(bucket), np.concatenate(window), np.concatenate(word_hash), of_word[opens])


def distinct_hits(known: np.ndarray, b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that ``known`` marks and their windows in order, those of a word that a window repeats once."""
    here = np.flatnonzero(known[b.bucket])
    order = here[np.lexsort((b.bucket[here], b.word[here], b.window[here]))]
    bucket, word, window = b.bucket[order], b.word[order], b.window[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1]) | (window[1:] != window[:-1])
    return bucket[new], window[new]


def _parts(text: str) -> list[str]:
    """The text in parts of at most ``PART_CHARS`` characters, cut at white space where a part has any."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        piece = text[at:at + PART_CHARS]
        spaces = [m.start() for m in re.finditer(r"\s", piece[-65536:])] if len(piece) > 65536 else []
        cut = at + len(piece) - 65536 + spaces[-1] + 1 if spaces else at + PART_CHARS
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and parts of texts, about ``PART_CHARS`` characters at a time."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for part in _parts(text or ""):
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= PART_CHARS:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


@dataclass(frozen=True)
class Model:
    """What a bucket adds to the logit, per n-gram of the bag, and the bias."""

    weight: np.ndarray
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The logit of each text's worst window."""
        out = np.full(len(texts), -np.inf)
        for rows, parts in _slices(texts):
            b = bags(parts)
            if len(b.text):
                n = np.bincount(b.window, minlength=len(b.text))
                hit, window = distinct_hits(self.weight != 0, b)
                total = np.bincount(window, weights=self.weight[hit], minlength=len(b.text))
                np.maximum.at(out, np.asarray(rows)[b.text], self.bias + GAIN * total / (n + PADDING))
        out[np.isneginf(out)] = self.bias
        return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod ``FOLDS``; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``(text, toxic)`` of the sample, and how many ids of documents are labelled either way."""
    told = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 0)
    one = told.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = materialize(one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = SAMPLE_ROWS // 2
    take = {1: max(half, SAMPLE_ROWS - counts.get(0, 0)), 0: max(half, SAMPLE_ROWS - counts.get(1, 0))}
    order = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    ids = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in take.items()]
    chosen = materialize(ids[0].unionByName(ids[1]), "sampled_ids")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    release(known, chosen)
    return sample, counts


def _features(sample: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """Buckets that toxic texts hold more often than clean ones, by a normal deviate."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_class = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for row, text in enumerate(b.column("text").to_pylist()):
                parts = [np.unique(bags([p]).bucket) for p in _parts(text)]
                in_class[int(toxic[row]), np.unique(np.concatenate(parts))] += 1
        bucket = np.flatnonzero(in_class.any(axis=0))
        for at in range(0, len(bucket), 10_000):
            k = bucket[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(in_class[0, k]), pa.array(in_class[1, k])], names=["bucket", "clean", "toxic"])

    spread = sample.repartition(min(64, max(1, int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "doc_id")
    found = spread.select("text", "toxic").mapInArrow(held, "bucket long, clean long, toxic long")
    summed = found.groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p, q = (F.col("t") + 0.5) / (counts[1] + 1), (F.col("c") + 0.5) / (counts[0] + 1)
    both = (F.col("t") + F.col("c") + 1) / (counts[0] + counts[1] + 2)
    deviate = (p - q) / F.sqrt(both * (1 - both) * (1 / (counts[1] + 1) + 1 / (counts[0] + 1)) + 1e-12)
    chosen = summed.filter((F.col("t") + F.col("c") >= LEAST_TEXTS) & (deviate >= LEAST_DEVIATE)).orderBy(F.desc(deviate), "bucket").limit(FEATURES)
    return np.array([r["bucket"] for r in chosen.select("bucket").collect()], dtype=np.int64)


def _hits(sample: DataFrame, features: np.ndarray) -> pa.Table:
    """A row for each sampled window: its text's hash and class, how many n-grams it has, and those with a vector."""
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    shared = sample.sparkSession.sparkContext.broadcast(place)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, toxic = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "toxic"))
            for rows, parts in _slices(b.column("text").to_pylist()):
                x = bags(parts)
                n = np.bincount(x.window, minlength=len(x.text))
                hit, of = distinct_hits(known >= 0, x)
                offsets = np.searchsorted(of, np.arange(len(n) + 1))
                row = np.asarray(rows)[x.text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(toxic[row].astype(np.int32)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(known[hit]))],
                    names=["at", "toxic", "n", "hits"],
                )

    rows = sample.select(F.xxhash64(F.col("doc_id").cast("string")).alias("at"), "toxic", "text")
    windows = materialize(rows.mapInArrow(cut, "at long, toxic int, n long, hits array<int>"), "windows")
    # texts in the order of their hashes, as long as all their windows' places stay within the bound
    sizes = windows.groupBy("at").agg(F.sum(F.size("hits") + 1).alias("k")).orderBy("at").toPandas()
    fits = sizes["at"][sizes["k"].cumsum() <= SAMPLE_HITS]
    bounded = windows if len(fits) == len(sizes) else windows.filter(F.col("at") <= int(fits.max() if len(fits) else -(2**63)))
    out = bounded.toArrow()
    release(windows)
    return out


def train(at: np.ndarray, toxic: np.ndarray, n: np.ndarray, hits: np.ndarray, offsets: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Vectors and softmax fitted by Adam; the logit that each feature adds and the bias, for classes of equal weight.

    A window's logit is linear in its features once vectors and softmax are
    multiplied, so a step needs one number per place, and the gradients of both
    factors follow from one sum per feature.
    """
    _, doc = np.unique(at, return_inverse=True)
    docs = int(doc.max()) + 1
    y = np.zeros(docs)
    y[doc] = toxic
    share = y.mean()
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / docs
    window = np.repeat(np.arange(len(n)), np.diff(offsets))
    n_of_doc = np.bincount(doc, weights=n, minlength=docs)
    rng = np.random.default_rng(42)
    vectors, softmax, bias = rng.normal(0, 0.1, (features, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    order = np.lexsort((np.arange(len(doc)), doc))
    edges = np.searchsorted(doc[order], np.arange(docs))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, softmax, bias)]
    for step in range(1, STEPS + 1):
        whole = step <= STEPS // 3
        bag, count, bags_ = (doc[window], n_of_doc, docs) if whole else (window, n, len(n))
        v = vectors @ (softmax[:, 1] - softmax[:, 0])
        logit = GAIN * np.bincount(bag, weights=v[hits], minlength=bags_) / (count + PADDING) + bias[1] - bias[0]
        if whole:
            of_doc, worst = logit, np.arange(docs)
        else:
            peak = np.maximum.reduceat(logit[order], edges)
            is_peak = np.flatnonzero(logit[order] == peak[doc[order]])
            worst = order[is_peak[np.unique(doc[order][is_peak], return_index=True)[1]]]
            of_doc = logit[worst]
        delta = np.zeros(bags_)
        delta[worst] = (1 / (1 + np.exp(-of_doc)) - y) * balance
        q = GAIN * np.bincount(hits, weights=(delta / (count + PADDING))[bag], minlength=features)
        turn = np.array([-1.0, 1.0])
        grads = [np.outer(q, softmax[:, 1] - softmax[:, 0]) + DECAY * vectors, np.outer(vectors.T @ q, turn) + DECAY * softmax, delta.sum() * turn]
        for x, g, (m, s) in zip((vectors, softmax, bias), grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            s += 0.001 * g * g
            x -= RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, toxic)`` for the texts of ``docs``; held-out ids are not looked at."""
    ship_package(docs.sparkSession)
    sample, counts = _sampled(docs, labels)
    total = sum(counts.values())
    weight = np.zeros(BUCKETS, dtype=np.float32)
    if not (counts.get(0) and counts.get(1)):
        release(sample)
        share = min(max(counts.get(1, 0) / max(total, 1), 1e-12), 1 - 1e-12)
        return Model(weight, float(np.log(share / (1 - share))))
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    features = _features(sample, taken)
    t = _hits(sample, features).combine_chunks()
    release(sample)
    prior = float(np.log(counts[1] / counts[0]))
    if not t.num_rows or not len(features):
        return Model(weight, prior)
    held = t.column("hits").chunk(0)
    at, toxic, n = (t.column(c).to_numpy() for c in ("at", "toxic", "n"))
    if len(np.unique(toxic)) < 2:
        return Model(weight, prior)
    added, bias = train(at, toxic, n, held.flatten().to_numpy(), held.offsets.to_numpy(), len(features))
    weight[features] = added
    return Model(weight, bias + prior)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``held_out``, ``score`` and ``predicted``."""
    docs = docs.drop("held_out", "score", "predicted")
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            with np.errstate(over="ignore"):
                found = 1 / (1 + np.exp(-own.logits(b.column(text).to_pylist())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "score"])

    scored = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumns({"held_out": fold(F.col("doc_id")) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
