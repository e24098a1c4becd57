"""Spelling variants: words one edit apart, found among sorted permuterm rotations.

A word is closed by a terminator and turned to each of its places. In the
rotation that ends with a word's i-th character, the rest, read from the place
after it, is the word without that character: the *key*. Words that differ in
that character alone share the key, and a word that lacks it has the key as a
whole rotation of its own. So every word emits its rotations whole, and once
more without their last character; equal keys, brought together by one shuffle
and scanned in sorted order, hold exactly the words one edit apart. A key is met
by one word as a whole and, beyond it, by one word for each character of the
alphabet, so no group grows with the corpus, however common a word is.

A pair that differs by a replaced character meets under one key. One that
differs by an inserted character meets once for each place in a run of equal
characters that may be the inserted one; only the first place counts it.

A form is the near word of largest count, if at least ``TIMES`` the word's; a
chain of forms doubles the count at each step, so the roots are found by a
logarithmic number of joins of forms with forms.

Defined results: a null or empty text has no runs; a null id counts as an
empty one; repeated rows count each; texts are read whole, whatever their
length; ties go to the smaller word in code-point order; an empty table gives
an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import ascii_lower
from tidemark.llm.grouped import runs
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release

#: Letters of a run, and the rule by which a run loses a character.
RUN = r"[A-Za-zÀ-ÿ]+"
SLIP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2
#: Before every letter in code-point order, and no letter.
END = "$"


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of all words of ``LEAST_LENGTH`` characters and more that ``docs(doc_id, text)`` hold ``LEAST_COUNT`` times or more."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    # no slip makes a run longer, so shorter ones are left out before anything is hashed
    low = found.filter(F.length("run") >= LEAST_LENGTH).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = low.select("run", h.alias("h"))
    place = F.pmod("h", F.length("run")).cast("int")
    slipped = F.when(F.pmod("h", F.lit(SLIP)) == 0, F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(F.col("run"))
    counts = hashed.select(slipped.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def rotations(words: DataFrame) -> DataFrame:
    """``(key, word, n, whole, first)``: every rotation whole, and without its last character where that is a letter.

    ``first`` marks the first of a run of equal characters as the one left out.
    """
    at = F.col("at")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    part = lambda start, n: F.substring("word", start, n)
    before, after, rest = part(F.lit(1), at), part(at + 1, F.length("word")), part(at + 2, F.length("word"))
    letter, previous = part(at + 1, F.lit(1)), part(at, F.lit(1))
    both = F.array(
        F.struct(F.concat(after, F.lit(END), before).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first")),
        F.when(at < F.length("word"), F.struct(F.concat(rest, F.lit(END), before).alias("key"), F.lit(False).alias("whole"), ((at == 0) | (letter != previous)).alias("first"))),
    )
    return turned.select("word", "n", F.explode(both).alias("r")).filter("r is not null").select("r.key", "word", "n", "r.whole", "r.first")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of each group of equal keys: how many of its near words count here, and the best of all others in the group."""
    names = ["word", "n", "near", "best_n", "best"]
    for b in runs(batches, "key"):
        key, words = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "word"))
        n, whole, first = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "whole", "first"))
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        size = np.bincount(group)
        several = size[group] > 1
        if not several.any():
            continue
        words, n, whole, first = words[several], n[several], whole[several], first[several]
        group = pd.factorize(group[several])[0]
        size = np.bincount(group)
        own, marked = np.bincount(group, weights=whole), np.bincount(group, weights=~whole & first)
        near = np.where(whole, marked[group], size[group] - 1 - own[group] + own[group] * first).astype(np.int64)
        order = np.lexsort((words.astype(str), -n, group))
        begin = np.searchsorted(group[order], np.arange(len(size)))
        top, second = order[begin], order[begin + 1]
        other = np.where(np.arange(len(group)) == top[group], second[group], top[group])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), pa.array(near), pa.array(n[other]), pa.array(words[other], pa.string())], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` for every row of ``words(word, n)``, whose words are distinct."""
    ship_package(words.sparkSession)
    dealt = rotations(words).repartition("key").sortWithinPartitions("key")
    met = dealt.mapInArrow(_scan, "word string, n long, near long, best_n long, best string")
    # largest n first, then the smaller word
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    told = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    holds = -F.col("b.m") >= TIMES * F.col("n")
    return words.join(told, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("b.w")).alias("form"), F.when(holds, -F.col("b.m")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every row of ``forms(word, form)``: where its chain of forms ends. No chain may come back to itself."""
    state, moved = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms"), 1
    while moved:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = state.select("word", "root").join(further, "root", "left")
        after = materialize(step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        release(state)
        state, moved = after, after.filter("moved").count()
    return state.select("word", "root")


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words of ``docs``."""
    words = materialize(corpus_words(docs, text), "words")
    known = materialize(near_words(words), "near")
    release(words)
    ends = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
