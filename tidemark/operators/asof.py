"""As-of joins and versions: what was known at a time, and nothing later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, values: list[str], forward: bool = False, within_days: int | None = None) -> DataFrame:
    """``left`` with ``time`` and ``values`` of the nearest ``right`` row of the same ``by``, at or before ``at`` (after it, if ``forward``).

    Both sides are put in one sequence per key, so there is one shuffle on
    ``by`` and no pair of rows is made. Rows without a match, or with one
    further than ``within_days`` away, keep nulls. Of equal times on the right
    one is taken; make them unique before.
    """
    seen = F.struct(F.col(time).alias("time"), *(F.col(v).alias(v) for v in values))
    rest = [c for c in left.columns if c not in by]
    rows = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_left"), F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType).alias("_seen"))
    known = right.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), seen.alias("_seen"))
    when = F.col("_t").desc() if forward else F.col("_t").asc()
    order = Window.partitionBy(*by).orderBy(when, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(known).withColumn("_near", F.last("_seen", ignorenulls=True).over(order)).filter("_side = 1")
    near = F.col("_near")
    if within_days is not None:
        near = F.when(F.abs(F.datediff("_t", "_near.time")) <= within_days, near)
    out = met.select(*by, "_left.*", near.alias("_n"))
    return out.select(*by, *rest, F.col("_n.time").alias(time), *(F.col(f"_n.{v}").alias(v) for v in values))


def latest_version(rows: DataFrame, by: list[str], available: str, version: str, cutoff: Column) -> DataFrame:
    """The row of each ``by`` last available at ``cutoff``; of equal times the larger version."""
    order = Window.partitionBy(*by).orderBy(F.desc(available), F.desc(version))
    return rows.filter(F.col(available) <= cutoff).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
