"""Inference and regression within groups, as windows over the group's rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import let
from tidemark.shipping import ship_package

#: The most rows of equal signals that one task orders at once, and the tasks they go to; larger ones are ordered by shuffles.
WIDE, PARTS = 2**20, 32


def newey_west(rows: DataFrame, value: str, order: str, by: list[str], lags: int) -> DataFrame:
    """``by``, ``n``, ``mean``, ``se`` and ``t`` of a series with Bartlett weights; ``t`` is null without variance.

    Covariances divide by n, and a group of n rows uses n - 1 lags at most. Null values are left out.
    """
    group = Window.partitionBy(*by)
    centred = rows.filter(F.col(value).isNotNull()).withColumns({"_n": F.count("*").over(group), "_m": F.avg(value).over(group)}).withColumn("_e", F.col(value) - F.col("_m"))
    used, total = F.least(F.lit(lags), F.col("_n") - 1), F.col("_e") * F.col("_e")
    for k in range(1, lags + 1):
        weight = F.greatest(F.lit(0.0), 1 - k / (used + 1))
        total = total + 2 * weight * F.coalesce(F.col("_e") * F.lag("_e", k).over(group.orderBy(order)), F.lit(0.0))
    sums = centred.withColumn("_v", total).groupBy(*by).agg(F.max("_n").alias("n"), F.max("_m").alias("mean"), F.sum("_v").alias("_v"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("_v"))) / F.col("n")
    return sums.withColumn("se", se).select(*by, "n", "mean", "se", F.try_divide("mean", "se").alias("t"))


#: Abramowitz and Stegun 7.1.26, the complementary error function within 1.5e-7.
ERFC_P, ERFC_A = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)


def two_sided_p(t: Column) -> Column:
    """Two-sided normal p-value, within 1.5e-7."""
    x = F.abs(t) / math.sqrt(2)
    u = 1 / (1 + ERFC_P * x)
    return F.least(F.lit(1.0), _horner(ERFC_A, u) * F.exp(-x * x))


def holm(rows: DataFrame, p: str, by: list[str], ties: str) -> DataFrame:
    """``rows`` with step-down ``adjusted`` p-values within ``by``: the running maximum of min(1, (m - i) p).

    Rows without a p-value are left out.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(p, ties)
    step = F.least(F.lit(1.0), (F.count("*").over(group) - F.row_number().over(order) + 1) * F.col(p))
    stepped = rows.filter(F.col(p).isNotNull()).withColumn("_step", step)
    return stepped.withColumn("adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def residual(y: str, x: str, by: list[str]) -> Column:
    """``y`` less its least-squares line in ``x`` within ``by``; only centred where ``x`` does not vary."""
    group = Window.partitionBy(*by)
    slope = F.coalesce(F.try_divide(F.covar_pop(y, x).over(group), F.var_pop(x).over(group)), F.lit(0.0))
    return F.col(y) - F.avg(y).over(group) - slope * (F.col(x) - F.avg(x).over(group))


def rank_bucket(value: str, by: list[str], ties: str, parts: int) -> Column:
    """Bucket 1 to ``parts`` with edges interpolated between ranks, so that sizes differ from those of ``ntile``."""
    group = Window.partitionBy(*by)
    r, n = F.row_number().over(group.orderBy(value, ties)), F.count("*").over(group)
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((r - 1) * parts / (n - 1)))).otherwise(1).cast("int")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, end: str, published: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row in force and published at ``at``; nulls where none is.

    Of several the one with the largest start and then publication is taken, by
    a maximum that is combined before the shuffle. Equal ``left`` rows meet once
    and are all returned.
    """
    known = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(published).alias("_p"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    in_force = (F.col("_s") <= F.col(at)) & (F.col("_e").isNull() | (F.col("_e") >= F.col(at))) & (F.col("_p") <= F.col(at))
    asked = left.groupBy(*left.columns).agg(F.count("*").alias("_times"))
    met = asked.join(known, [*(F.col(c) == F.col(f"_k{i}") for i, c in enumerate(by)), in_force], "left")
    best = met.groupBy(*left.columns, "_times").agg(F.max(F.struct("_s", "_p", *(f"_v{i}" for i in range(len(values))))).alias("_b"))
    again = best.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return again.select(*left.columns, *(F.col(f"_b._v{i}").alias(v) for i, v in enumerate(values)))


#: Acklam's rational approximation of the normal quantile, within 1.2e-9 of it.
PROBIT_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PROBIT_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
PROBIT_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PROBIT_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
PROBIT_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1."""
    tail = lambda q: _horner(PROBIT_C, q) / _horner(PROBIT_D, q)
    q = p - 0.5
    centre = _horner(PROBIT_A, q * q) * q / _horner(PROBIT_B, q * q)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < PROBIT_TAIL, tail(low)).when(p > 1 - PROBIT_TAIL, -tail(high)).otherwise(centre)


def rank_normal(value: str, by: list[str]) -> Column:
    """Normal score of the average rank of ``value`` within ``by``; null for nulls, and where fewer than two values are known."""
    known = F.col(value).isNotNull()
    group, same = Window.partitionBy(*by, known), Window.partitionBy(*by, value)
    n = F.count(value).over(group)
    share = (F.rank().over(group.orderBy(value)) + (F.count("*").over(same) - 1) / 2) / n
    return F.when(known & (n >= 2), probit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))))


def residual_of(rows: DataFrame, target: str, controls: list[str], by: list[str], within: list[str] | None = None, out: str = "residual") -> DataFrame:
    """Adds the least-squares residual of ``target`` on ``controls`` and a constant within ``by``, by Gram-Schmidt projections.

    With ``within`` (finer than ``by``) a constant for each of its groups takes
    the place of the common one, as dummies would. A control that the earlier
    ones explain, down to a sum of squares of 1e-20, is skipped.
    """
    group = Window.partitionBy(*by)
    centre = Window.partitionBy(*(within or by))
    left = [f"_c{i}" for i in range(len(controls))]
    work = rows.withColumns({name: F.col(c) - F.avg(c).over(centre) for name, c in zip(["_y", *left], [target, *controls], strict=True)})
    while left:
        base, *left = left
        size = F.sum(F.col(base) * F.col(base)).over(group)
        slope = {c: F.when(size > 1e-20, F.sum(F.col(c) * F.col(base)).over(group) / size).otherwise(0.0) for c in ("_y", *left)}
        work = work.withColumns({f"{c}_b": b for c, b in slope.items()})
        work = work.withColumns({c: F.col(c) - F.col(f"{c}_b") * F.col(base) for c in slope}).drop(base, *(f"{c}_b" for c in slope))
    return work.withColumnRenamed("_y", out)


def clustered_slope(rows: DataFrame, y: str, x: str, first: str, second: str) -> DataFrame:
    """One row: ``n``, ``slope``, ``se`` and ``t`` of ``y`` on ``x``, the error clustered by two keys (sum of both less their cells)."""
    both = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    moments = both.agg(F.struct(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(y, x).alias("cxy"), F.var_pop(x).alias("vx")).alias("fit"))
    fit = moments.scalar()
    slope = F.try_divide(fit["cxy"], fit["vx"])
    scored = both.withColumn("u", (F.col(x) - fit["mx"]) * (F.col(y) - fit["my"] - slope * (F.col(x) - fit["mx"])))
    # cells add up to either cluster, so one shuffle of rows feeds all three sums
    cells = scored.groupBy(first, second).agg(F.sum("u").alias("u"))
    squares = lambda sums: sums.agg(F.sum(F.col("u") * F.col("u"))).scalar()
    meat = squares(cells.groupBy(first).agg(F.sum("u").alias("u"))) + squares(cells.groupBy(second).agg(F.sum("u").alias("u"))) - squares(cells)
    out = moments.select(F.col("fit.n").alias("n"), F.try_divide("fit.cxy", "fit.vx").alias("slope"), (F.col("fit.n") * F.col("fit.vx")).alias("size"), meat.alias("meat"))
    out = out.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), F.col("meat"))) / F.col("size"))
    return out.select("n", "slope", "se", F.try_divide("slope", "se").alias("t"))


def block_bootstrap(rows: DataFrame, value: str, order: str, by: list[str], block: int, repetitions: int, seed: str) -> DataFrame:
    """``by``, ``n``, ``mean``, ``low`` and ``high``: the interpolated 2.5 % and 97.5 % quantiles of means of resampled series.

    A repetition strings together blocks of ``block`` neighbours, whose starts
    come from a SHA-256 of the seed, its number and the block's, and is cut to
    the series' length. A block's sum is a difference of the series' running
    sums, which are one array for each of ``by``; no block is spelled out.
    """
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    series = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), listed.alias("_l"))
    upto = F.aggregate(f"_l.{value}", F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    summed = series.select(*by, "n", "mean", upto.alias("_u"), F.least(F.lit(block), F.col("n")).alias("_b"))
    tried = summed.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).repartition(*by, "_r")

    def part(k: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "_r", k), 256), 1, 13), 16, 10).cast("long") % (F.col("n") - F.col("_b") + 1)
        size = F.least(F.col("_b"), F.col("n") - k * F.col("_b"))
        return let(drawn, lambda s: F.get("_u", s + size) - F.get("_u", s))

    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("_b")) - 1), part), F.lit(0.0), lambda acc, v: acc + v)
    means = tried.select(*by, "n", "mean", (total / F.col("n")).alias("_m"))
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by, "n", "mean").agg(q.alias("_q")).select(*by, "n", "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))


def _order(digests: list[bytes]) -> np.ndarray:
    """Places in the order of the digests: by their first eight bytes, by all of them where two agree in those."""
    head = np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64)
    order = np.argsort(head)
    if len(order) > 1 and (head[order[1:]] == head[order[:-1]]).any():
        return np.array(sorted(range(len(digests)), key=digests.__getitem__))
    return order


def _drawn_in_tasks(tied: DataFrame, signal: str, result: str, by: list[str], key: str, simulations: int, seed: str) -> DataFrame:
    """``by``, ``_dl`` and ``_dh``: what the drawn rows of equal signals add to either tail, over the simulations of a task.

    Rows of equal signals travel as one row to ``PARTS`` tasks; a task counts how often each is drawn.
    """
    ship_package(tied.sparkSession)
    at = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for first, low, high, keys, results in zip(*(c.to_pylist() for c in b.columns[at : at + 4]), b.column(at + 4), strict=True):
                ends = [k.encode() for k in keys]
                times = np.zeros((2, len(ends)))
                for s in range(first, simulations, PARTS):
                    start = f"{seed}|{s}".encode()
                    order = _order([sha256(start + end).digest() for end in ends])
                    times[0, order[:low]] += 1
                    times[1, order[len(ends) - high :]] += 1
                value = results.values.to_numpy(zero_copy_only=False)
                sums.append([float(np.dot(t[t > 0], value[t > 0])) for t in times])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *map(pa.array, np.array(sums).reshape(-1, 2).T)], names=[*by, "_dl", "_dh"])

    # the seed and the simulation come before it; a null key adds nothing
    end = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit(""))
    listed = tied.groupBy(*by, signal).agg(F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_same").alias("_same"), F.collect_list(F.struct(end.alias("k"), F.coalesce(F.col(result).cast("double"), F.lit(0.0)).alias("v"))).alias("_l"))
    # a tail that holds all of the value's rows, or none, draws none
    part = lambda c: F.when(F.col(c) < F.col("_same"), F.col(c)).otherwise(0).cast("int").alias(c)
    tasks = listed.select(*by, signal, part("_low"), part("_high"), F.col("_l.k").alias("_k"), F.col("_l.v").alias("_v")).withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, simulations) - 1))))
    dealt = tasks.repartition(4 * PARTS, *by, signal, "_first").select(*by, "_first", "_low", "_high", "_k", "_v")
    return dealt.mapInArrow(run, T.StructType([*(tied.schema[c] for c in by), T.StructField("_dl", T.DoubleType()), T.StructField("_dh", T.DoubleType())]))


def tie_averaged_spread(rows: DataFrame, signal: str, result: str, by: list[str], key: str, simulations: int, seed: str, parts: int = 5) -> DataFrame:
    """``by``, ``tail_n`` and ``spread`` of equal tails, ties ordered by hashes and averaged over ``simulations`` of them; null below ``parts`` rows.

    Only the values of the signal at the two boundaries are drawn from; all
    other rows of a tail are in it whatever the draw, and are counted once.
    A value's rows are drawn from inside tasks, and no draw becomes a row
    unless more than ``WIDE`` rows share the value.
    """
    group = Window.partitionBy(*by)
    below, same = F.rank().over(group.orderBy(signal)) - 1, F.count("*").over(Window.partitionBy(*by, signal))
    known = rows.withColumns({"_n": F.count("*").over(group), "_below": below, "_same": same})
    told = known.withColumn("_t", F.when(F.col("_n") >= parts, F.greatest(F.lit(1), F.floor(F.col("_n") / parts))))
    # how many of a value's rows belong to either tail
    low = F.greatest(F.lit(0), F.least(F.col("_same"), F.col("_t") - F.col("_below")))
    high = F.greatest(F.lit(0), F.least(F.col("_same"), F.col("_below") + F.col("_same") - (F.col("_n") - F.col("_t"))))
    told = told.withColumns({"_low": low, "_high": high})
    whole = lambda c: F.sum(F.when(F.col(c) == F.col("_same"), F.col(result)))
    fixed = told.groupBy(*by).agg(F.max("_t").alias("_t"), whole("_low").alias("_fl"), whole("_high").alias("_fh"))
    part = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("_same"))
    tied = told.filter(part("_low") | part("_high"))
    drawn = tied.filter(F.col("_same") > WIDE).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    order = Window.partitionBy(*by, signal, "_s").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "_s", key), 256))
    placed = drawn.withColumn("_r", F.row_number().over(order))
    taken = lambda c, inside: F.when(part(c) & inside, F.col(result))
    apart = placed.select(*by, taken("_low", F.col("_r") <= F.col("_low")).alias("_dl"), taken("_high", F.col("_r") > F.col("_same") - F.col("_high")).alias("_dh"))
    near = _drawn_in_tasks(tied.filter(F.col("_same") <= WIDE), signal, result, by, key, simulations, seed)
    means = apart.unionByName(near).groupBy(*by).agg(F.sum("_dl").alias("_dl"), F.sum("_dh").alias("_dh"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tail = lambda f, d: (zero(f) + zero(F.col(d) / simulations)) / F.col("_t")
    out = fixed.join(means, by, "left")
    return out.select(*by, F.coalesce("_t", F.lit(0)).alias("tail_n"), (tail("_fh", "_dh") - tail("_fl", "_dl")).alias("spread"))


def tie_diagnostics(rows: DataFrame, signal: str, by: list[str], parts: int = 5) -> DataFrame:
    """``by``, distinct signals, the largest share of one, and how many rows share the signal at either tail's boundary."""
    counts = rows.groupBy(*by, signal).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = counts.withColumns({"upto": F.sum("c").over(group.orderBy(signal)), "n": F.sum("c").over(group)})
    tail = F.greatest(F.lit(1), F.floor(F.col("n") / parts))
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
    return upto.groupBy(*by).agg(
        F.count("*").alias("distinct_signals"), F.max(F.col("c") / F.col("n")).alias("largest_share"),
        F.max(F.when(holds(F.col("n") - tail + 1), F.col("c"))).alias("top_ties"), F.max(F.when(holds(tail), F.col("c"))).alias("bottom_ties"),
    )
