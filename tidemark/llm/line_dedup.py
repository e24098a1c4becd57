"""Line deduplication: deletion-neighbourhood join, earliest line kept.

Lines are lower-cased and their white space collapsed. A line is dropped if an
earlier one, by ``(doc_id, digest of the text, line number)``, is within its
edit bound: one word replaced, inserted or deleted for lines of ``MIN_WORDS``
words and more, none for shorter ones, which only go where they repeat exactly.
"Earlier" does not ask whether that line is itself dropped, so the result is
fixed by the corpus alone and needs no rounds.

How links are found, without pairs within a group:

* equal lines collapse into classes named by their earliest place;
* lines one edit apart share their first or their last half of words, so only
  classes that share a half with another class go on;
* each of those emits every variant with one word deleted outside that half, as
  a key: its length, the place, and the exclusive or of the 64-bit hashes of the
  words left with their places. Two lines with an equal variant at the same
  place differ by a replacement; a variant equal to a whole line is a deletion.
  Each key keeps only its earliest members, and each line is compared with
  those, word by word.

Keys with a large share of all rows are salted in every join.

Defined results: a null text stays null and has no lines; lines without words
are never dropped; rows that repeat a ``doc_id`` and its
text are the same document, so their lines are not duplicates of each other;
different texts under one ``doc_id`` or a null one are different documents; a
null ``doc_id`` comes before all others; an empty table gives an empty result;
columns named ``n_lines``, ``n_dropped`` and ``dropped`` are replaced, and all
others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, running_xor
from tidemark.functions.names import unused
from tidemark.operators.skew import join_per_key
from tidemark.sources.scratch import materialize, release, sized

#: Lines of fewer words have an edit bound of zero.
MIN_WORDS = 5


def _cut(text: Column) -> Column:
    """A text's lines, lower-cased, with spaces for all white space; one scan of the text instead of one per line."""
    plain = F.when(text.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)
    return F.split(F.lower(plain), "\n", -1)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def _digest(text: str) -> Column:
    """What tells rows of one ``doc_id`` apart."""
    return F.xxhash64(text)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """``(doc_id, digest, line_no, words)`` of the lines with words.

    Words are made inside the generator: a filter on a projected column would
    be pushed below it, and each line cut up twice.
    """
    cut = F.transform(_cut(F.col(text)), _words)
    return docs.select("doc_id", _digest(text).alias("digest"), F.posexplode(cut).alias("line_no", "words")).filter(F.size("words") > 0)


def _chosen_lines(docs: DataFrame, text: str, chosen: DataFrame) -> DataFrame:
    """``chosen(class, first, sides)`` with the ``words`` of the lines at these places; other lines are not cut into words."""
    at = F.struct(F.col("first.line_no").alias("i"), "class", "sides")
    wanted = materialize(
        chosen.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.digest").alias("_digest")).agg(F.collect_list(at).alias("_at")), "wanted"
    )
    told = docs.select("doc_id", _digest(text).alias("digest"), F.col(text).alias("text"))
    met = told.join(sized(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")))
    words = let(_cut(F.col("text")), lambda lines: F.transform("_at", lambda x: F.struct(x["i"].alias("i"), x["class"].alias("class"), x["sides"].alias("sides"), _words(F.get(lines, x["i"])).alias("words"))))
    found = met.select("doc_id", "digest", F.inline(words))
    found = materialize(found.select(F.struct("doc_id", "digest", F.col("i").alias("line_no")).alias("first"), "class", "sides", "words").dropDuplicates(["class"]), "found")
    release(wanted)
    return found


def _bounds(n: Column) -> tuple[Column, Column]:
    """The two ways to halve ``n`` words, the same for an odd number."""
    return F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")


#: Keys of the first and the last half of a line, for both ways to halve an even number of words.
HALVES = ("first_high", "last_high", "first_low", "last_low")


def _halves(words: Column) -> dict[str, Column]:
    """The keys of ``HALVES``; null for short lines, and the low ones for odd numbers of words."""
    n = F.size(words)
    low, high = _bounds(n)

    def key(name: str) -> Column:
        side, h = name.split("_")[0], high if name.endswith("high") else low
        part = F.slice(words, 1, h) if side == "first" else F.slice(words, n - h + 1, h)
        return F.when((n >= MIN_WORDS) & (F.lit(True) if name.endswith("high") else low < high), F.xxhash64(F.lit(side), h, part))

    return {name: key(name) for name in HALVES}


def _variants(words: Column, sides: Column) -> Column:
    """``array<struct<role, at, key>>``: S a word masked in place, D a word deleted, W the whole line.

    ``at`` is the length of the sequence that is left, and for S the place too.
    Two lines that share a half differ outside it, so only words there are left
    out; bit ``k`` of ``sides`` tells that half ``k`` of ``HALVES`` is shared.
    An exclusive or makes each variant cost the same, however long the line.
    """
    n = F.size(words)
    low, high = _bounds(n)
    has = lambda k: sides.bitwiseAND(F.lit(1 << k)) != 0
    begin = F.when(has(2), low).when(has(0), high).otherwise(n)
    end = F.when(has(3), n - low).when(has(1), n - high).otherwise(F.lit(0))
    spots = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i >= begin) | (i < end))
    variant = lambda role, at, key: F.struct(F.lit(role).alias("role"), at.cast("long").alias("at"), key.alias("key"))

    def build(here: Column, left: Column, moved: Column, total: Column, rest: Column) -> Column:
        masked = F.transform(spots, lambda i: variant("S", n.cast("long") * 2**31 + i, total.bitwiseXOR(F.get(here, i))))
        before = lambda i: F.get(left, i).bitwiseXOR(F.get(here, i))
        deleted = F.transform(spots, lambda i: variant("D", 1 - n, before(i).bitwiseXOR(rest).bitwiseXOR(F.get(moved, i))))
        return F.concat(masked, deleted, F.array(variant("W", -n, total)))

    def prefixed(here: Column, left: Column, moved: Column) -> Column:
        ends = F.struct(F.element_at(left, -1).alias("total"), F.element_at(moved, -1).alias("rest"))
        return let(ends, lambda e: build(here, left, moved, e["total"], e["rest"]))

    hashed = lambda shift: F.transform(words, lambda w, j: F.xxhash64(w, j - shift))
    return let(hashed(0), lambda here: let(running_xor(here), lambda left: let(running_xor(hashed(1)), lambda moved: prefixed(here, left, moved))))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are equal but for one replaced, inserted or deleted word."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: ~e)) <= 1

    def deleted(long: Column, short: Column) -> Column:
        differs = F.filter(F.transform(short, lambda w, i: F.when(w != F.get(long, i), i)), lambda i: i.isNotNull())
        at = F.coalesce(F.get(differs, 0), F.size(short))
        return let(at, lambda p: F.slice(long, p + 2, F.size(long)) == F.slice(short, p + 1, F.size(short)))

    return (
        F.when(F.size(a) == F.size(b), same)
        .when(F.size(a) == F.size(b) + 1, deleted(a, b))
        .when(F.size(b) == F.size(a) + 1, deleted(b, a))
        .otherwise(False)
    )


def _near_classes(docs: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """``class`` of every class that has an earlier class one edit away."""
    halves = F.array(*(F.struct(F.lit(1 << k).alias("bit"), F.col(name).alias("half")) for k, name in enumerate(HALVES)))
    keys = materialize(classes.select("class", F.inline(halves)).filter("half is not null"), "halves")
    shared = materialize(keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    sides = join_per_key(keys, shared, ["half"], "n", keys.count(), "class").groupBy("class").agg(F.bit_or("bit").alias("sides"))
    chosen = materialize(classes.select("class", "first").join(sides, "class"), "chosen")
    release(keys, shared)
    found = _chosen_lines(docs, text, chosen)
    # ids rise with the place, so that the earliest of a key is the least id
    words = materialize(found.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "words")
    release(chosen, found)
    variants = materialize(words.select("id", F.inline(_variants(F.col("words"), F.col("sides")))), "variants")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.col("id"))).alias(role)
    met = materialize(variants.groupBy("at", "key").agg(F.count("*").alias("n"), *(earliest(r) for r in "SWD")).filter("n > 1"), "met")
    partner = F.when(F.col("role") == "S", F.col("S")).when(F.col("role") == "W", F.col("D")).otherwise(F.col("W"))
    partnered = join_per_key(variants, met, ["at", "key"], "n", variants.count(), "id")
    pairs = materialize(partnered.select("id", partner.alias("other")).filter("other < id").distinct(), "pairs")
    release(variants, met)
    asked = pairs.groupBy("other").agg(F.count("*").alias("n"))
    b = asked.join(words.select(F.col("id").alias("other"), F.col("words").alias("b")), "other")
    compared = join_per_key(pairs.join(words.select("id", "class", F.col("words").alias("a")), "id"), b, ["other"], "n", pairs.count(), "id")
    near = materialize(compared.filter(_one_edit(F.col("a"), F.col("b"))).select("class").distinct(), "near")
    release(words, pairs)
    return near


def dropped_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, digest, dropped)``: the sorted numbers, from 0, of the lines to drop; documents without any are absent."""
    lines = materialize(
        _lines(docs, text).select(
            F.struct("doc_id", "digest", "line_no").alias("place"),
            F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("second"), "words").alias("h2"),
            *(half.alias(name) for name, half in _halves(F.col("words")).items()),
        ), "lines",
    )
    grouped = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first"), *(F.min(name).alias(name) for name in HALVES))
    classes = materialize(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    near = _near_classes(docs, text, classes)
    flagged = materialize(
        classes.join(near.withColumn("near", F.lit(True)), "class", "left").select("h1", "h2", "n", "first", F.coalesce("near", F.lit(False)).alias("near"))
        .filter("near or n > 1"), "flagged",
    )
    release(near, classes)
    met = join_per_key(lines.select("place", "h1", "h2"), flagged, ["h1", "h2"], "n", lines.count(), "place")
    by_doc = met.filter("near or place <> first").groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.digest").alias("digest"))
    gone = materialize(by_doc.agg(F.sort_array(F.collect_set("place.line_no")).alias("dropped")), "dropped")
    release(lines, flagged)
    return gone


def _kept_text(text: Column, dropped: Column) -> Column:
    """The lines between dropped ones, joined again."""

    def rest(lines: Column, cuts: Column) -> Column:
        stretch = lambda d, k: F.slice(lines, d + 2, F.coalesce(F.get(cuts, k + 1), F.size(lines)) - d - 1)
        return F.array_join(F.flatten(F.transform(cuts, stretch)), "\n")

    return let(F.split(text, "\n", -1), lambda lines: let(F.concat(F.array(F.lit(-1)), dropped), lambda cuts: rest(lines, cuts)))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``text`` rebuilt from the kept lines, ``n_lines``, ``n_dropped`` and ``dropped``."""
    docs = docs.drop("n_lines", "n_dropped", "dropped")
    key, mark = unused(docs, "_doc", "_digest")
    gone = sized(dropped_lines(docs.select("doc_id", text), text)).withColumnsRenamed({"doc_id": key, "digest": mark})
    none = F.array().cast("array<int>")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (_digest(text) == F.col(mark)), "left")
    return joined.select(
        *(F.when(F.col("dropped").isNull(), F.col(c)).otherwise(_kept_text(F.col(c), F.col("dropped"))).alias(c) if c == text else c for c in docs.columns),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``dropped`` line numbers, and the SHA-256 of the text that is left."""
    from tidemark.sources.tables import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
