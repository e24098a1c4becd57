"""Returns on capital, as reported and with intangible spending as an asset written off in equal parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capital_returns(rows: DataFrame, by: list[str], period: str, life: int = 5, tax: float = 0.25, overhead: float = 0.0) -> DataFrame:
    """``by``, ``period`` and the returns of each row of ``(revenue, nopat, capital, reinvestment, research, sga)``.

    What is spent in a period is written off in equal parts over the ``life``
    periods after it. ``period`` is a whole number, distinct within ``by``: with
    calendar years a year without a row still ages what came before. The charge
    is a moving sum; the asset left, the spending times its remaining share, is
    two moving sums, of the spending and of the spending times its period. So no
    row meets another, and a group is sorted once.

    Null spending counts as none; a return is null where its base is zero or
    null, and incremental returns are null in a group's first row.
    """
    order = Window.partitionBy(*by).orderBy(period)
    spent = F.coalesce("research", F.lit(0)).cast("double") + F.coalesce("sga", F.lit(0)).cast("double") * overhead
    at = F.col(period).cast("double")
    past, held = order.rangeBetween(-life, -1), order.rangeBetween(-life + 1, 0)
    total = lambda x, window: F.coalesce(F.sum(x).over(window), F.lit(0.0))
    known = rows.withColumn("intangible", spent)
    aged = known.withColumn("amortization", total(F.col("intangible"), past) / life)
    # the share left of what was spent k periods ago is (life - k) / life
    aged = aged.withColumn("asset", ((life - at) * total(F.col("intangible"), held) + total(F.col("intangible") * at, held)) / life)
    saved = F.col("intangible") - F.col("amortization")
    adjusted = aged.withColumns({"adjusted_nopat": F.col("nopat") + saved * (1 - tax), "adjusted_capital": F.col("capital") + F.col("asset"), "adjusted_reinvestment": F.col("reinvestment") + saved})
    share = lambda x, y: F.try_divide(x, F.when(y != 0, y))
    step: dict[str, Column] = {c: F.col(c) - F.lag(c).over(order) for c in ("nopat", "adjusted_nopat")}
    return adjusted.select(
        *by, period, "intangible", "amortization", "asset", "adjusted_nopat", "adjusted_capital", "adjusted_reinvestment",
        share(F.col("nopat"), F.col("capital")).alias("roic"), share(F.col("adjusted_nopat"), F.col("adjusted_capital")).alias("adjusted_roic"),
        share(step["nopat"], F.col("reinvestment")).alias("roiic"), F.when(F.col("reinvestment") != 0, share(step["adjusted_nopat"], F.col("adjusted_reinvestment"))).alias("adjusted_roiic"),
        share(F.col("reinvestment"), F.col("nopat")).alias("reinvestment_rate"), share(F.col("adjusted_reinvestment"), F.col("adjusted_nopat")).alias("adjusted_reinvestment_rate"),
    )


def capital_profile(returns: DataFrame, rows: DataFrame, by: list[str], period: str) -> DataFrame:
    """One row of each of ``by``: periods, median returns, the latest incremental ones, and what was spent on purchases, own shares and dividends."""
    told = returns.groupBy(*by).agg(
        F.count("*").alias("periods"), F.percentile("roic", 0.5).alias("median_roic"), F.percentile("adjusted_roic", 0.5).alias("median_adjusted_roic"),
        F.max_by("roiic", period).alias("latest_roiic"), F.max_by("adjusted_roiic", period).alias("latest_adjusted_roiic"),
    )
    spent = rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("acquisitions", "buybacks", "dividends")))
    return told.join(spent, by)
