"""Positions of rows within ordered groups, without one task for a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import unused
from tidemark.sources.scratch import materialize, release, sized


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place (from 0) of each in its group by ``order``, which should leave no ties.

    Rows are dealt by ranges of group and order, so a group of any size is spread
    over tasks; a place is the row's number within its range and group plus the
    group's rows in the ranges before. Null keys form a group. The result is a
    written table.
    """
    task, own, before, n = unused(rows, "_task", "_own", "_before", "_n")
    dealt = rows.repartitionByRange(*by, *order).withColumn(task, F.spark_partition_id())
    held = materialize(dealt.withColumn(own, F.row_number().over(Window.partitionBy(task, *by).orderBy(*order))), "dealt")
    sums = held.groupBy(*by, task).agg(F.count("*").alias(n))
    # a group has one row here for each task that holds some of it
    ahead = sums.withColumn(before, F.sum(n).over(Window.partitionBy(*by).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)))
    told = materialize(ahead.select(*(F.col(c).alias(f"{c}{before}") for c in by), F.col(task).alias(f"{task}{before}"), before), "ahead")
    same = F.col(task) == F.col(f"{task}{before}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}{before}"))
    out = materialize(held.join(sized(told), same).withColumn(name, (F.col(own) - 1 + F.coalesce(before, F.lit(0))).cast("long")).select(*rows.columns, name), "numbered")
    release(held, told)
    return out
