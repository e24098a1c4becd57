"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all documents over its
present one. Each document inverts a Poisson distribution of that mean at a
uniform number hashed from its id and text, is repeated so often, and all copies
are shuffled by a hash. Rows with the same id and text are numbered, so that
each is drawn, and placed, on its own. A rate over ``MAX_RATE`` is cut into equal parts, each drawn
from a number of its own, and the counts are added: their sum has the whole
rate. One aggregation over sources, one shuffle of the copies, into at least as
many partitions as keep ``PARTITION_ROWS`` copies each.

Defined results: a null source is a source of its own; documents of a source
without a weight are left out; an empty table gives an empty result; rows that
repeat a ``doc_id``, or have none, are drawn each by their own text, and if that
repeats too by their number; null ids and texts count as empty ones; texts are
carried whole; columns named ``rate``, ``n_copies``, ``copy`` and
``shuffle_key`` are replaced, and all others stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.names import unused
from tidemark.operators.positions import numbered
from tidemark.operators.skew import join_per_key
from tidemark.sources.scratch import materialize, sized, small

#: Weight of a source of n documents, where none are given: n to this power.
TEMPERATURE = 0.5
SEED = 42
#: The greatest rate of one draw: the distribution is summed term by term.
MAX_RATE = 200.0
#: Copies to a partition of the result, at most in the mean.
PARTITION_ROWS = 200_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def _cumulative(rate: Column) -> Column:
    """P(count <= k) for k from 0, until the rest is below 1e-17."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), top),
        start,
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * rate / k)).alias("cdf")
        ),
        lambda a: a["cdf"],
    )


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source") -> DataFrame:
    """``(source, n, rate, parts, cdf)``, ``cdf`` being that of one of ``parts`` draws; ``weights(source, weight)`` need not add up to one."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = weights.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
        weighed = counts.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    counted = materialize(weighed, "sources")
    totals = counted.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    rate = F.col("w") / F.lit(totals["w"]) * F.lit(totals["n"]) / F.col("n")
    parted = counted.withColumn("rate", rate).withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
    return materialize(parted.select("source", "n", "rate", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("cdf")), "rates")


def _named(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: the id and the MD5 of the text, and from the second row with both on the row's number among them."""
    told = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    again = materialize(docs.select(told.alias(name)).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name), "repeated")
    keyed = docs.withColumn(name, told)
    if not again.limit(1).count():
        return keyed
    repeated = sized(again)
    row, at = unused(keyed, "_row", "_at")
    several = numbered(keyed.join(repeated, name, "left_semi").withColumn(row, F.monotonically_increasing_id()), [name], [row], at)
    marked = F.when(F.col(at) > 0, F.concat(F.col(name), F.lit(":"), F.col(at) + 1)).otherwise(F.col(name))
    return keyed.join(repeated, name, "left_anti").unionByName(several.withColumn(name, marked).drop(row, at))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", seed: int = SEED) -> DataFrame:
    """The copies of ``docs`` with ``rate``, ``n_copies``, ``copy`` (from 1) and ``shuffle_key``, in shuffled order."""
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    rates = source_rates(docs, weights, source)
    name, of, n, parts, cdf = unused(docs, "_name", "_source", "_n", "_parts", "_cdf")
    told = rates.withColumnsRenamed({"source": of, "n": n, "parts": parts, "cdf": cdf})
    named = _named(docs, name)
    if small(rates):
        drawn = named.join(F.broadcast(told), F.col(source).eqNullSafe(F.col(of))).drop(of)
    else:
        # more sources than can be broadcast: the common ones are salted
        key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("none"))
        total = rates.agg(F.sum("n")).first()[0] or 0
        kept = told.withColumn(f"{of}_", key(of)).withColumn(f"{n}_", F.col(n)).drop(of)
        drawn = join_per_key(named.withColumn(f"{of}_", key(source)), kept, [f"{of}_"], f"{n}_", total, name).drop(f"{of}_")
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u)).cast("long")
    draw = lambda *which: uniform(F.lit(str(seed)), F.lit("count"), F.col(name), *which)
    later = F.aggregate(F.transform(F.sequence(F.lit(2), F.col(parts)), lambda k: draw(k.cast("string"))), F.lit(0).cast("long"), lambda total, u: total + below(u))
    first = let(draw(), below)
    counted = drawn.withColumn("n_copies", first + F.when(F.col(parts) > 1, later).otherwise(0)).drop(n, parts, cdf)
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(name), F.col("copy")))).drop(name)
    # the rates add up to the number of documents of the sources with a weight
    expected = rates.agg(F.sum(F.col("n") * F.col("rate"))).first()[0] or 0
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / PARTITION_ROWS))
    return keyed.repartition(spread, "shuffle_key").sortWithinPartitions("shuffle_key")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Each copy's ``doc_id``, ``source``, ``rate``, ``n_copies``, ``copy``, ``shuffle_key`` and the SHA-256 of its text."""
    from tidemark.sources.tables import table

    out = mix_sources(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return out.select("doc_id", "source", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key", digest)


OP9_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, sqrt(n::DOUBLE) AS w FROM n),
r AS (SELECT source, rate, parts, rate / parts AS each FROM (SELECT *, greatest(ceil(rate / 200), 1)::BIGINT AS parts FROM (
        SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(n)::DOUBLE FROM w) / n AS rate FROM w))),
m AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
e AS (SELECT *, key || CASE WHEN k > 1 THEN ':' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY key) AS k FROM m)),
d AS (SELECT row_number() OVER () AS id, doc_id, name, text, documents.source, rate, parts, each FROM e AS documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
u AS (SELECT id, source, each, ('0x' || substr(md5('42:count:' || name || CASE WHEN part > 1 THEN ':' || part ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d, LATERAL (SELECT unnest(range(1, parts + 1)) AS part)),
t AS (SELECT source, k, sum(exp(-each + k * ln(each) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, LATERAL (SELECT unnest(range(0, ceil(each + 10 * sqrt(each) + 20)::BIGINT + 1)) AS k)),
c AS (SELECT id, sum((SELECT count(*) FROM t WHERE t.source IS NOT DISTINCT FROM u.source AND t.cdf <= u.u))::BIGINT AS n_copies FROM u GROUP BY id)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies, copy,
       md5('42:order:' || name || ':' || copy::VARCHAR) AS shuffle_key,
       sha256(coalesce(text, '')) AS text_sha256
FROM c JOIN d USING (id), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy)
"""
