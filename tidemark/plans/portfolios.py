"""Backtests of the signal panel: a portfolio for each market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as P
from tidemark.plans.views import prices, securities, signals
from tidemark.sources.scratch import materialize

END_AT = "2001-06-30"
#: Small enough a capital that most trades fit a day's amount, and more names than trade on any one day.
RULES = P.Rules(top_n=5, capital=1e5)


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("market", "signal_date").orderBy(F.desc("signal"), "ticker")
    ranked = signals(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "market"), "ticker").withColumn("rank", F.row_number().over(order))
    panel = prices(spark, sf_dir).select("ticker", F.col("price_date").alias("at"), "close", F.col("amount").alias("volume"))
    return ranked.filter(F.col("rank") <= RULES.top_n).select(F.col("market").alias("portfolio"), F.col("signal_date").alias("signal_at"), "ticker", "rank"), panel


def locked(spark, sf_dir: str) -> DataFrame:
    """Each rebalance with its locked names, turnover, cost and use of the day's amount."""
    out = P.rebalances(P.backtest(*_inputs(spark, sf_dir), END_AT, RULES))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def capacity(spark, sf_dir: str) -> DataFrame:
    """Rebalances that would take more of a day's amount than allowed, by portfolio."""
    steps = P.rebalances(P.backtest(*_inputs(spark, sf_dir), END_AT, RULES))
    return steps.groupBy("portfolio").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "OVER_CAPACITY").alias("over"), F.round(F.max("utilization"), 6).alias("largest"))


def marks(spark, sf_dir: str) -> DataFrame:
    """Value and drawdown of each portfolio on every day that one of its names has a price."""
    wanted, panel = _inputs(spark, sf_dir)
    # read three times, so the simulation is written once
    curve = P.equity(materialize(P.backtest(wanted, panel, END_AT, RULES), "steps"), panel)
    return curve.select("portfolio", "at", F.round("value", 4).alias("value"), F.round("drawdown", 6).alias("drawdown"))


def full_performance(spark, sf_dir: str) -> DataFrame:
    wanted, panel = _inputs(spark, sf_dir)
    steps = materialize(P.backtest(wanted, panel, END_AT, RULES), "steps")
    out = P.performance(P.equity(steps, panel), steps, RULES.capital)
    return out.select("portfolio", *(F.round(c, 6).alias(c) for c in out.columns if c != "portfolio"))


QUERIES = {"backtest_locked": locked, "backtest_capacity": capacity, "equity_marks": marks, "backtest_full_performance": full_performance}

#: None: the recurrence over holdings is tested by hand-worked cases instead.
ORACLE_SQL: dict[str, str] = {}
