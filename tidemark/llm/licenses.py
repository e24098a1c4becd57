"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a stretch of ``BLOCK_WORDS`` of the text's words, line breaks parting
words like any other; stretches start every half of that, so any passage of half
a block lies whole in one. A template
meets a block if the block holds at least ``THRESHOLD`` of the template's
distinct words. The join orders tokens by their frequency over the whole
corpus, rarest first, and compares only blocks that hold one of a template's
first tokens (prefix filter), are long enough (length filter) and can still
reach the threshold from that token's places in both (positional filter);
what is left is counted exactly.

Text is cut into words once to count tokens and once to join; only documents
with a prefix token are cut into blocks. Templates are a fixed table, so they
are broadcast.

Defined results: a null text is an empty one; texts of any length are scanned
whole; labels are those of the row's own text, whether its ``doc_id`` repeats or
is null, and equal texts are scanned once; an empty table gives an empty result;
columns with the names of results are replaced, and all others stay, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.names import unused
from tidemark.sources.scratch import materialize, sized

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening sentences of public licenses, A-Z lower-cased.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
}
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_WORDS = 64
THRESHOLD = 0.8


def _spaced(text: Column) -> Column:
    """The text's words between single spaces, and a space at either end; letters keep their case."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), BREAKS, " ")


def _lower_words(text: Column) -> Column:
    trimmed = F.btrim(_spaced(text))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " ", -1)
    )


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and all columns but ``text``, with ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base``, an array of labels."""
    kept = docs.drop("n_words", "n_base", "first_word", "last_word", "base")
    spaced, pieces, hits = unused(kept, "_spaced", "_pieces", "_hits")
    phrase = "(?i)(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    any_phrase = F.col(spaced).rlike(phrase)
    none = F.array().cast("array<string>")
    cut = kept.withColumn(spaced, _spaced(F.coalesce(F.col(text), F.lit(""))))
    found = cut.withColumns({
        hits: F.when(any_phrase, F.regexp_extract_all(spaced, F.lit(phrase), F.lit(0))).otherwise(none),
        pieces: F.when(any_phrase, F.split(spaced, phrase, -1)).otherwise(none),
        "n_words": _spaces(F.col(spaced)) - 1,
    })
    labels = [F.when(F.exists(hits, lambda h: F.lower(h) == phrase), F.lit(label)) for phrase, label in PHRASES.items()]
    last_start = F.col("n_words") - (_spaces(F.element_at(pieces, -1)) - 1) - (_spaces(F.element_at(hits, -1)) + 1)
    return found.select(
        *[c for c in kept.columns if c != text],
        "n_words",
        F.size(hits).cast("long").alias("n_base"),
        F.when(F.size(hits) > 0, _spaces(F.get(pieces, 0)) - 1).alias("first_word"),
        F.when(F.size(hits) > 0, last_start).alias("last_word"),
        F.array_sort(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("base"),
    )


def _template_rows() -> list[tuple[int, str, list[str]]]:
    flat = [(label, t) for label, texts in TEMPLATES.items() for t in texts]
    return [(at, label, list(dict.fromkeys(t.split()))) for at, (label, t) in enumerate(flat)]


def token_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of texts that hold them, rarest first, then by spelling."""
    held = F.array_intersect(F.col("words"), F.array(*map(F.lit, vocabulary)))
    rows = words.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    found = {r["token"]: r["n"] for r in rows}
    return sorted(vocabulary, key=lambda t: (found.get(t, 0), t))


def _blocks(text: Column) -> Column:
    """Stretches of ``BLOCK_WORDS`` words, starting every half of that."""
    half = BLOCK_WORDS // 2
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / half).cast("int") - 2, F.lit(0)))
    return let(_lower_words(text), lambda w: F.transform(starts(w), lambda k: F.slice(w, k * half + 1, BLOCK_WORDS)))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def template_matches(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, label, containment)`` of every text, by its ``text_key``, and label with a block that meets one of its templates."""
    spark = docs.sparkSession
    templates = _template_rows()
    vocabulary = sorted({t for _, _, tokens in templates for t in tokens})
    body = F.coalesce(F.col(text), F.lit(""))
    order = token_order(docs.select(_lower_words(body).alias("words")), vocabulary)
    at = {t: i for i, t in enumerate(order)}
    index, sets = [], []
    for key, label, tokens in templates:
        ordered = sorted(tokens, key=at.get)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        sets.append((key, label, ordered, need))
        index += [(t, key, place, len(ordered), need) for place, t in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = sorted({row[0] for row in index})
    index_df = F.broadcast(spark.createDataFrame(index, "token string, template int, place int, size int, need int"))
    sets_df = F.broadcast(spark.createDataFrame(sets, "template int, label string, tokens array<string>, _need int"))

    rare = "(?i)(?<= )(?:" + "|".join(prefixes) + ")(?= )"
    # of equal texts any one will do; only texts with a prefix token travel
    near = docs.select(body.alias("body")).filter(_spaced(F.col("body")).rlike(rare))
    a, b = text_key(F.col("body"))
    once = near.groupBy(a.alias("a"), b.alias("b")).agg(F.first("body").alias("body"))
    blocks = once.select("a", "b", F.explode(_blocks(F.col("body"))).alias("block"))
    known = F.array(*map(F.lit, order))
    # array_intersect keeps the order of its first argument: the frequency order
    ordered = blocks.select("a", "b", F.array_intersect(known, "block").alias("held"))
    ordered = ordered.filter(F.arrays_overlap("held", F.array(*map(F.lit, prefixes))))
    probes = ordered.select("a", "b", "held", F.posexplode("held").alias("spot", "token"))
    met = probes.join(index_df, "token").filter(
        (F.size("held") >= F.col("need")) & (1 + F.least(F.size("held") - F.col("spot") - 1, F.col("size") - F.col("place") - 1) >= F.col("need"))
    )
    counted = met.join(sets_df, "template").withColumn("shared", F.size(F.array_intersect("held", "tokens"))).filter("shared >= need")
    return counted.groupBy("a", "b", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``phrase_places`` with ``found``, an array of the labels of templates met, and ``score``, the largest containment."""
    bare = docs.drop("found", "score")
    a, b = (f"{c}_" for c in unused(bare, "_key_a", "_key_b", "found", "score")[:2])
    keyed = bare.withColumns(dict(zip((a, b), text_key(F.coalesce(F.col(text), F.lit(""))), strict=True)))
    places = phrase_places(keyed, text)
    found = template_matches(docs, text).groupBy("a", "b").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("containment").alias("score"))
    found = sized(materialize(found.withColumnsRenamed({"a": f"{a}2", "b": f"{b}2"}), "licenses"))
    joined = places.join(found, (F.col(a) == F.col(f"{a}2")) & (F.col(b) == F.col(f"{b}2")), "left").drop(a, b, f"{a}2", f"{b}2")
    none = F.array().cast("array<string>")
    return joined.withColumns({"found": F.coalesce("found", none), "score": F.coalesce("score", F.lit(0.0))})


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.tables import table

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        "score",
    )
