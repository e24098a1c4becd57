"""Ranks, quantiles and cross-sectional statistics within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(same) - 1) / 2


def winsorize(rows: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99, out: str | None = None) -> DataFrame:
    """``value`` clipped at its interpolated quantiles within ``by``."""
    cuts = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    clipped = F.greatest(F.get("_q", F.lit(0)), F.least(F.get("_q", F.lit(1)), F.col(value)))
    return rows.join(cuts, by).withColumn(out or value, F.when(F.col(value).isNotNull(), clipped)).drop("_q")


def rank_correlation(x: str, y: str, least: int = 5) -> Column:
    """An aggregate: correlation of two columns of ranks; null below ``least`` rows or without two distinct ranks on either side."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # corr() divides by zero under ANSI where a side does not vary
    ratio = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count("*") >= least) & varied, ratio)


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """``by``, ``n`` and ``ic``; null below ``least`` pairs or without two distinct values on either side."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.select(*by, x, y, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rank_correlation("_x", "_y", least).alias("ic"))


def tail_spread(rows: DataFrame, signal: str, result: str, by: list[str], key: str, parts: int = 5) -> DataFrame:
    """Mean result of the highest n // ``parts`` signals less that of the lowest; ties ordered by the SHA-256 of ``key``."""
    order = Window.partitionBy(*by).orderBy(F.col(signal), F.sha2(key, 256))
    placed = rows.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*by))})
    tail = F.floor(F.col("_n") / parts)
    low, high = F.when(F.col("_r") <= tail, F.col(result)), F.when(F.col("_r") > F.col("_n") - tail, F.col(result))
    return placed.groupBy(*by).agg(F.max(tail).alias("tail_n"), (F.avg(high) - F.avg(low)).alias("spread"))


def weighted_quantiles(rows: DataFrame, value: str, weight: str, by: list[str], hundredths: dict[str, int]) -> DataFrame:
    """``by`` and a column for each of ``hundredths``: the least value up to which that share of the weight lies, 0 to 100.

    Weights of equal values are added before anything is sorted; with decimal
    weights the comparison is exact. Null values and weights are left out; a
    share of 0 gives the least value.
    """
    sums = rows.filter(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    group = Window.partitionBy(*by)
    run = sums.withColumns({"_c": F.sum("_w").over(group.orderBy("_v")), "_t": F.sum("_w").over(group)})
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("_c") * 100 >= F.col("_t") * share, F.col("_v"))).alias(name) for name, share in hundredths.items()))
