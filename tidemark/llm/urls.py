"""URL verdicts: longest matching rule, else a Bloom filter cascade over listed domains.

The keys are domains: a host is listed if it or a domain above it is. The
cascade is exact for every domain of the corpus's hosts and needs no join with
them. Level 0 encodes the listed domains of the corpus; level 1 the others that
pass level 0; level 2 the listed ones that pass level 1; and so on until none
pass. A domain is listed if the first level it fails is odd. The filters are
built by Spark from all domains of all hosts. Domains are dealt by a hash into
as many shards as keep a shard's filters within ``SHARD_BYTES``; each shard has
a cascade of its own, and they are built, broadcast and applied one by one.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; the empty host has no domains; an empty list, or no pages,
blocks nothing by list; null keys of the list are left out; urls of any length
are taken whole; repeated rows are judged each; columns with the names of
results are replaced, and all others stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import ascii_lower
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize, release

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The query's list: these sites under each of these domains.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_UNDER = ("example.com", "example.net", "example.org")
SHARD_BYTES = 16 << 20
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer, salted."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """``hashes`` places in a filter for each pair of 64-bit hashes, a row per hash."""
    first, step = _mixed(a.astype(np.int64).view(np.uint64), 2 * level), _mixed(b.astype(np.int64).view(np.uint64), 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(i) * step) % np.uint64(bits) for i in range(hashes)])


def _passes(a: np.ndarray, b: np.ndarray, at: int, level: Level) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for place in _positions(a, b, at, level.bits, level.hashes):
        out &= (level.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _build(keys: DataFrame, at: int, n: int, rate: float) -> Level:
    """A filter of ``n`` keys ``(a, b)``: bits are set in tasks and joined by word."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            place = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), at, bits, hashes))
            word, start = np.unique(place >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    made = keys.select("a", "b").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[made["word"].to_numpy()] = made["value"].to_numpy(dtype=np.int64).view(np.uint64)
    return Level(bits, hashes, words)


def _passing(keys: DataFrame, at: int, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_passes(a.to_numpy(), b.to_numpy(), at, shared.value))

    return keys.filter(passes("a", "b"))


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for ``universe(a, b, listed)``, one row per key."""
    sides = {True: universe.filter("listed"), False: universe.filter("not listed")}
    n = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, others, levels = n.get(True, 0), n.get(False, 0), []
    rate = min(0.5, math.sqrt(0.5) * inside / others) if inside and others else 0.5
    while inside:
        at = len(levels)
        member = at % 2 == 0
        level = _build(sides[member], at, inside, rate)
        levels.append(level)
        passed = materialize(_passing(sides[not member], at, level), "cascade")
        release(sides[not member])
        sides[not member] = passed
        inside, rate = passed.count(), 0.5
    release(*sides.values())
    return levels


def in_cascade(spark, levels: list[Level], a: Column, b: Column) -> Column:
    """Whether any of the keys with hashes in the arrays ``a`` and ``b`` is listed; exact for keys of the universe."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def listed(a: pd.Series, b: pd.Series) -> pd.Series:
        row = np.repeat(np.arange(len(a)), a.map(len))
        x, y = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in (a, b))
        found, alive = np.zeros(len(x), dtype=bool), np.arange(len(x))
        for at, level in enumerate(shared.value):
            ok = _passes(x[alive], y[alive], at, level)
            found[alive[~ok]] = at % 2 == 1
            alive = alive[ok]
        found[alive] = len(shared.value) % 2 == 1
        return pd.Series(np.isin(np.arange(len(a)), row[found]))

    return listed(a, b)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def domains(host: Column) -> Column:
    """The host and all domains above it; none of an empty host."""
    labels = F.split(host, r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(above)


def mark_listed(rows: DataFrame, listed: DataFrame, host: str = "host", mark: str = "listed") -> DataFrame:
    """Adds ``mark``: whether ``rows[host]`` is or lies under a domain of ``listed(key)``."""
    spark = rows.sparkSession
    on_list = listed.select("key").filter("key is not null").distinct().withColumn("listed", F.lit(True))
    keys = rows.select(host).distinct().select(F.explode(domains(F.col(host))).alias("key")).distinct()
    known = keys.join(on_list, "key", "left").select(*_hashes(F.col("key")), F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = materialize(known, "universe")
    inside, total = universe.agg(F.count_if("listed"), F.count("*")).first()
    # levels after the first two add up to about as many bits again as their keys
    bits = inside * (3 + 1.45 * max(1.0, math.log2(max(total, 1) / max(inside, 1))))
    shards = max(1, math.ceil(bits / 8 / SHARD_BYTES))
    out = rows.withColumn(mark, F.lit(False))
    for shard in range(shards):
        mine = lambda a: F.pmod(a, F.lit(shards)) == shard  # noqa: E731, B023
        levels = build_cascade(universe.filter(mine(F.col("a"))))
        pairs = F.filter(F.transform(domains(F.col(host)), lambda d: F.struct(*_hashes(d))), lambda x: mine(x["a"]))
        out = out.withColumn(mark, F.col(mark) | in_cascade(spark, levels, pairs["a"], pairs["b"]))
        if shards > 1:
            before, out = out, materialize(out, "marked")
            release(before)
    release(universe)
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, PARTS, 1)), F.regexp_extract(whole, PARTS, 2)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``listed``; ``listed(key)`` are the domains on the list."""
    ship_package(pages.sparkSession)
    host, path = url_parts(F.col(url))
    known = mark_listed(pages.drop("host", "path", "rule", "verdict", "listed").withColumns({"host": host, "path": path}), listed)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return known.withColumns({"rule": rule, "verdict": verdict})


def listed_domains(spark) -> DataFrame:
    """The query's list, ``(key)``."""
    return spark.createDataFrame([(f"{site}.{under}",) for site in LISTED_SITES for under in LISTED_UNDER], "key string")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """Judges every page; ``listed`` tells whether the list names its host."""
    from tidemark.sources.tables import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, listed_domains(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
l AS (SELECT site || '.' || under AS key
      FROM unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS a(site),
           unnest(['example.com', 'example.net', 'example.org']) AS b(under)),
j AS (SELECT *, EXISTS (SELECT 1 FROM l WHERE host = key OR ends_with(host, '.' || key)) AS listed,
        CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  listed FROM j
"""
