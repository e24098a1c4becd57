"""Permutations and bootstraps of rank correlations.

Draws are values of a cubic polynomial over the field of ``FIELD`` elements,
whose coefficients come from the SHA-256 of a seed and the sample's number; any
four of a sample's draws are independent. They are whole-number arithmetic, so
any engine repeats them. Rows of a group are known by their place, ranks are
taken once. A group of up to ``WIDE`` rows travels as one row of small arrays to
``PARTS`` tasks, each of which draws its share of the samples and returns one
row of sums a sample; no draw becomes a row. In larger groups each group and
sample is a group of its own for every shuffle and window. All sums are whole
numbers, so both ways agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import let
from tidemark.operators.ranks import average_rank
from tidemark.shipping import ship_package
from tidemark.sources.scratch import materialize

FIELD = 2**31 - 1
#: The most rows of a group that one task takes at once: sums of three ranks' products stay below 2 ** 63, places below 2 ** 20.
WIDE = 2**20
#: Tasks to a group.
PARTS = 64


def coefficients(seed: str, sample: str) -> Column:
    """The sample's four coefficients, of twelve hexadecimal digits each."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), sample), 256)
    return let(digest, lambda d: F.array(*(F.conv(F.substring(d, 12 * k + 1, 12), 16, 10).cast("long") % FIELD for k in range(4))))


def drawn(c: Column, x: Column) -> Column:
    """The polynomial at ``x``, below ``FIELD``."""
    out = F.get(c, F.lit(3))
    for k in (2, 1, 0):
        out = (out * x + F.get(c, F.lit(k))) % FIELD
    return out


def _ranked(rows: DataFrame, columns: list[str], by: list[str], key: str) -> DataFrame:
    """``by``, the place ``_i`` (from 1), ``_n``, and twice each column's average rank; rows with a null in any are left out."""
    whole = rows.dropna(subset=[*by, *columns]).select(*by, key, *columns)
    group = Window.partitionBy(*by)
    return whole.select(
        *by, F.row_number().over(group.orderBy(key)).cast("long").alias("_i"), F.count("*").over(group).alias("_n"), *((2 * average_rank(c, by)).cast("long").alias(c) for c in columns)
    )


def _samples(groups: DataFrame, samples: int, seed: str) -> DataFrame:
    return groups.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_c", coefficients(seed, "_s"))


def _draws(seed: str, sample: int, x: np.ndarray) -> np.ndarray:
    """``drawn`` of ``coefficients`` at places up to ``WIDE``: two folds of 31 bits instead of a remainder."""
    digest = sha256(f"{seed}|{sample}".encode()).hexdigest()
    *rest, out = (int(digest[12 * k : 12 * k + 12], 16) % FIELD for k in range(4))
    for c in reversed(rest):
        out = out * x + c
        out = (out & FIELD) + (out >> 31)
    out = (out & FIELD) + (out >> 31)
    out[out == FIELD] = 0
    return out


def _permuted(seed: str, columns: list[np.ndarray]) -> Callable[[int], list[int]]:
    """Sums of products of each score with the result, the last column, that a sample deals."""
    *scores, result = columns
    x = np.arange(1, len(result) + 1, dtype=np.int64)

    def sums(sample: int) -> list[int]:
        order = np.sort(_draws(seed, sample, x) << 20 | x - 1) & (WIDE - 1)
        return [int(np.dot(c[order], result)) for c in scores]

    return sums


def _redrawn(seed: str, columns: list[np.ndarray]) -> Callable[[int], list[int]]:
    """Of each column, the sum of twice its ranks and of their squares in a sample; of all but the last, the sum of products with the last."""
    size = len(columns[0])
    x = np.arange(1, size + 1, dtype=np.int64)
    codes = [np.unique(c, return_inverse=True)[1] for c in columns]
    orders = [np.argsort(c, kind="stable") for c in codes]
    starts = [np.searchsorted(c[o], np.arange(c.max() + 1)) for c, o in zip(codes, orders, strict=True)]

    def sums(sample: int) -> list[int]:
        times = np.bincount(_draws(seed, sample, x) % size, minlength=size)
        ranks, out = [], []
        for code, order, start in zip(codes, orders, starts, strict=True):
            same = np.add.reduceat(times[order], start)
            twice = 2 * np.cumsum(same) - same + 1
            out += [int(np.dot(same, twice)), int(np.dot(same * twice, twice))]
            ranks.append(twice[code])
        last = times * ranks[-1]
        return [*out, *(int(np.dot(r, last)) for r in ranks[:-1])]

    return sums


def _in_tasks(ranked: DataFrame, columns: list[str], by: list[str], samples: int, seed: str, begin: Callable, names: list[str]) -> DataFrame:
    """``by``, ``_s`` and the long columns ``names`` that ``begin`` gives for a sample, of groups of at most ``WIDE`` rows."""
    ship_package(ranked.sparkSession)
    at = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                sums = begin(seed, [c.flatten().to_numpy().astype(np.int64) for c in row.columns[at + 1:]])
                own = range(row.column(at)[0].as_py(), samples, PARTS)
                told = np.array([sums(s) for s in own], dtype=np.int64).reshape(-1, len(names))
                group = [c.take(pa.array(np.zeros(len(own), dtype=np.int64))) for c in row.columns[:at]]
                yield pa.RecordBatch.from_arrays([*group, pa.array(own, pa.int32()), *map(pa.array, told.T)], names=[*by, "_s", *names])

    listed = ranked.filter(F.col("_n") <= WIDE).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_l"))
    arrays = (F.col("_l")[c].cast("array<int>").alias(f"_v{k}") for k, c in enumerate(columns))
    parts = listed.select(*by, *arrays).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, samples) - 1))))
    schema = T.StructType([*(ranked.schema[c] for c in by), T.StructField("_s", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])
    dealt = parts.repartition(2 * PARTS, *by, "_part").select(*by, "_part", *(f"_v{k}" for k in range(len(columns))))
    return dealt.mapInArrow(run, schema)


def permutation_p_values(rows: DataFrame, scores: list[str], result: str, by: list[str], key: str, samples: int, seed: str) -> DataFrame:
    """``by``, ``label``, ``n``, ``ic`` and ``p``: the share of permutations whose correlation is as large as the observed one, plus one in both counts.

    All scores meet the same permutations of ``result``. Whether one is as large
    is decided by whole numbers: under a permutation only the sum of products of
    ranks changes. A score or result that does not vary has no ``ic``, and its
    ``p`` counts no permutation.
    """
    ranked = materialize(_ranked(rows, [*scores, result], by, key), "ranked")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    sums = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *(F.sum(exact(c) * exact(result)).cast("decimal(38,0)").alias(f"_xy_{c}") for c in scores), *(F.sum(c).alias(f"_x_{c}") for c in [*scores, result]), *(F.sum(exact(c) * exact(c)).cast("decimal(38,0)").alias(f"_xx_{c}") for c in [*scores, result]))
    order = Window.partitionBy(*by, "_s").orderBy("_v", "_i")
    # the row in the place-th position of the drawn order gets the result of that place
    wide = ranked.filter(F.col("_n") > WIDE)
    dealt = _samples(wide.select(*by, "_i", *scores), samples, seed).withColumn("_v", drawn(F.col("_c"), F.col("_i"))).select(*by, "_s", *scores, "_v", "_i")
    placed = dealt.withColumn("_i", F.row_number().over(order).cast("long"))
    met = placed.join(wide.select(*by, "_i", result), [*by, "_i"])
    tried = met.groupBy(*by, "_s").agg(*(F.sum(exact(c) * exact(result)).cast("decimal(38,0)").alias(f"_p_{c}") for c in scores))
    few = _in_tasks(ranked, [*scores, result], by, samples, seed, _permuted, [f"_p_{c}" for c in scores])
    tried = tried.unionByName(few.select(*by, "_s", *(exact(f"_p_{c}").alias(f"_p_{c}") for c in scores)))
    both = tried.join(sums, by)
    far = lambda c, xy: F.abs(F.col("_n") * F.col(xy) - exact(f"_x_{c}") * exact(f"_x_{result}"))
    counts = both.groupBy(*by).agg(*(F.count_if(far(c, f"_p_{c}") >= far(c, f"_xy_{c}")).alias(f"_e_{c}") for c in scores))
    known = counts.join(sums, by)
    spread = lambda c: F.col("_n") * F.col(f"_xx_{c}") - exact(f"_x_{c}") * exact(f"_x_{c}")

    def told(c: str) -> Column:
        varies = (spread(c) > 0) & (spread(result) > 0)
        ic = F.when(varies, (F.col("_n") * F.col(f"_xy_{c}") - exact(f"_x_{c}") * exact(f"_x_{result}")).cast("double") / F.sqrt(spread(c).cast("double") * spread(result).cast("double")))
        return F.struct(F.lit(c).alias("label"), F.col("_n").alias("n"), ic.alias("ic"), ((F.when(varies, F.col(f"_e_{c}")).otherwise(0) + 1) / (samples + 1)).alias("p"))

    return known.select(*by, F.inline(F.array(*map(told, scores))))


def _intervals(values: DataFrame, labels: Mapping[str, Column], by: list[str]) -> DataFrame:
    """``by``, ``label``, ``valid``, the interpolated 2.5 % and 97.5 % quantiles, and the share of positive values."""
    shares = F.array(F.lit(0.025), F.lit(0.975))
    named = values.select(*by, *(v.alias(f"_l{i}") for i, v in enumerate(labels.values())))
    told = lambda i, name: F.struct(F.lit(name).alias("label"), F.count(f"_l{i}").alias("valid"), F.percentile(f"_l{i}", shares).alias("q"), F.avg((F.col(f"_l{i}") > 0).cast("double")).alias("positive"))
    agg = named.groupBy(*by).agg(*(told(i, name).alias(f"_a{i}") for i, name in enumerate(labels)))
    flat = agg.select(*by, F.inline(F.array(*(f"_a{i}" for i in range(len(labels))))))
    return flat.select(*by, "label", "valid", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "positive")


def bootstrap_correlations(rows: DataFrame, first: str, second: str, result: str, by: list[str], key: str, samples: int, seed: str) -> DataFrame:
    """Intervals of the rank correlations of two scores with ``result``, and of the first less the second, over rows drawn with replacement.

    A sample is how often each row is drawn. A row drawn m times counts m times
    in every rank: its average rank follows from the draws up to its value and
    those of its value. Samples in which a column does not vary are not valid.
    """
    columns = [first, second, result]
    ranked = materialize(_ranked(rows, columns, by, key), "ranked")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    wide = ranked.filter(F.col("_n") > WIDE)
    sizes = wide.groupBy(*by).agg(F.max("_n").alias("_n"))
    spots = _samples(sizes, samples, seed).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*by, "_s", (drawn(F.col("_c"), F.col("_j")) % F.col("_n") + 1).alias("_i"))
    times = spots.groupBy(*by, "_s", "_i").agg(F.count("*").alias("_m"))
    met = times.join(wide.drop("_n"), [*by, "_i"])
    upto = lambda c: F.sum("_m").over(Window.partitionBy(*by, "_s").orderBy(c))
    same = lambda c: F.sum("_m").over(Window.partitionBy(*by, "_s", c))
    again = met.select(*by, "_s", "_m", *((2 * upto(c) - same(c) + 1).alias(c) for c in columns))
    product = lambda *cs: F.sum(F.col("_m") * exact(cs[0]) * (exact(cs[1]) if len(cs) > 1 else 1)).cast("decimal(38,0)")
    moments = {**{f"_x_{c}": product(c) for c in columns}, **{f"_xx_{c}": product(c, c) for c in columns}, **{f"_xy_{c}": product(c, result) for c in (first, second)}}
    names = [*(f"{kind}_{c}" for c in columns for kind in ("_x", "_xx")), *(f"_xy_{c}" for c in (first, second))]
    few = _in_tasks(ranked, columns, by, samples, seed, _redrawn, names)
    told = again.groupBy(*by, "_s").agg(*(m.alias(name) for name, m in moments.items()))
    # as many draws as rows
    sums = told.unionByName(few.select(*by, "_s", *(exact(name).alias(name) for name in names))).join(ranked.groupBy(*by).agg(F.max("_n").alias("n")), by)
    size = lambda c: F.col("n") * F.col(f"_xx_{c}") - F.col(f"_x_{c}") * F.col(f"_x_{c}")
    real = lambda c: c.cast("double")
    # far below any difference of ranks: an ic of zero is zero in any order of adding
    ic = lambda c: F.when((size(c) > 0) & (size(result) > 0), F.round(real(F.col("n") * F.col(f"_xy_{c}") - F.col(f"_x_{c}") * F.col(f"_x_{result}")) / F.sqrt(real(size(c)) * real(size(result))), 12))
    both = sums.select(*by, ic(first).alias("a"), ic(second).alias("b")).filter("a is not null and b is not null")
    return _intervals(both, {first: F.col("a"), second: F.col("b"), f"{first}_less_{second}": F.round(F.col("a") - F.col("b"), 12)}, by)


def date_bootstrap(values: DataFrame, columns: list[str], date: str, samples: int, seed: str) -> DataFrame:
    """Intervals of the mean of each column over dates drawn with replacement, and of each pair's difference; dates with a null are left out."""
    whole = values.dropna(subset=columns)
    placed = whole.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)).cast("long").alias("_i"), *columns)
    size = placed.agg(F.count("*").alias("_n")).filter("_n > 0")
    spots = _samples(size, samples, seed).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_s", (drawn(F.col("_c"), F.col("_j")) % F.col("_n") + 1).alias("_i"))
    means = spots.join(placed, "_i").groupBy("_s").agg(*(F.avg(c).alias(c) for c in columns))
    labels = {c: F.col(c) for c in columns} | {f"{a}_less_{b}": F.col(a) - F.col(b) for i, a in enumerate(columns) for b in columns[i + 1:]}
    return _intervals(means.withColumn("_all", F.lit(0)), labels, ["_all"]).drop("_all")
