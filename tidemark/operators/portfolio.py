"""Backtests of ranked signals with locks, costs, capacity and settlement.

Spark reduces the price panel to what a portfolio asks for: its names' prices
at its own execution days. Only that small table, names times days, goes to the
recurrence, one group a portfolio. Marks between executions are joins again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.shipping import ship_package

STEPS = (
    "portfolio string, step int, execution_at date, ticker string, units double, cash double, pre_value double, post_value double, turnover double, cost double, "
    "requested int, selected int, locked int, utilization double, status string"
)


@dataclass(frozen=True)
class Rules:
    """Defaults of a backtest."""

    top_n: int = 10
    lag_days: int = 1
    cost_bps: float = 10.0
    slippage_bps: float = 5.0
    participation: float = 0.05
    capital: float = 1e8
    missing_exit_return: float = -1.0


def simulate(asked: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """The steps of one portfolio, a row for each holding after a step, or one without a name.

    A held name without a price on the day is locked: it keeps its units and
    takes no part in the rebalance. Requested names without a price are left
    out. The last step settles: names without a price at an assumed return.
    """
    rate = (rules.cost_bps + rules.slippage_bps) / 10_000
    cash, units, out = rules.capital, {}, []
    for step, rows in asked.sort_values(["step", "rank", "ticker"]).groupby("step", sort=True):
        exact = {t: p for t, p in zip(rows["ticker"], rows["exact"], strict=True) if pd.notna(p)}
        mark = dict(zip(rows["ticker"], rows["mark"], strict=True))
        volume = dict(zip(rows["ticker"], rows["volume"], strict=True))
        requested = [t for t, r in zip(rows["ticker"], rows["rank"], strict=True) if pd.notna(r)]
        values = {t: q * mark[t] for t, q in units.items()}
        pre = cash + sum(values.values())
        head = (rows["portfolio"].iloc[0], int(step), rows["execution_at"].iloc[0])
        if rows["terminal"].iloc[0]:
            gross = cash + sum(q * (exact[t] if t in exact else mark[t] * (1 + rules.missing_exit_return)) for t, q in units.items())
            cost, missing = gross * rate if units else 0.0, sum(t not in exact for t in units)
            out.append((*head, None, 0.0, gross - cost, pre, gross - cost, 1.0 if units else 0.0, cost, 0, 0, missing, None, "FORCED_SETTLEMENT" if missing else "SETTLED"))
            break
        locked = set(units) - set(exact)
        selected = [t for t in requested if t in exact]
        held = sum(values[t] for t in locked)
        free = max(0.0, 1 - held / pre)
        weight = free / len(selected) if selected else 0.0
        now = {t: v / pre for t, v in values.items() if t not in locked}
        moved = sum(abs((weight if t in selected else 0.0) - now.get(t, 0.0)) for t in set(now) | set(selected))
        turnover = (moved + abs((0.0 if selected else free) - cash / pre)) / 2
        cost = pre * rate * turnover
        post = pre - cost
        if post <= 0 or post - held < 0:
            out.append((*head, None, 0.0, cash, pre, post, turnover, cost, len(requested), len(selected), len(locked), None, "EXHAUSTED"))
            break
        each = (post - held) / len(selected) if selected else 0.0
        used = [abs(each - values.get(t, 0.0)) / volume[t] for t in selected if pd.notna(volume[t]) and volume[t] > 0]
        units = {t: units[t] for t in locked} | {t: each / exact[t] for t in selected}
        cash = 0.0 if selected else post - held
        status = "OVER_CAPACITY" if used and max(used) > rules.participation else "OK"
        tail = (cash, pre, post, turnover, cost, len(requested), len(selected), len(locked), max(used) if used else None, status)
        out += [(*head, t, q, *tail) for t, q in sorted(units.items())] or [(*head, None, 0.0, *tail)]
    return pd.DataFrame(out, columns=[part.split()[0] for part in STEPS.split(", ")])


def _of_names(prices: DataFrame, rows: DataFrame) -> DataFrame:
    """The prices of the names in ``rows``: no other is looked at, and portfolios hold few of all names."""
    return prices.join(rows.select("ticker").distinct(), "ticker", "left_semi")


def backtest(signals: DataFrame, prices: DataFrame, end_at: str, rules: Rules = Rules()) -> DataFrame:
    """``STEPS`` of every portfolio of ``signals(portfolio, signal_at, ticker, rank)`` over ``prices(ticker, at, close, volume)``.

    An execution is the first day with any price, at least ``lag_days`` after the signal.
    """
    ship_package(prices.sparkSession)
    calendar = prices.select(F.col("at").alias("day")).distinct().withColumn("all", F.lit(1)).withColumn("execution_at", F.col("day"))
    last = signals.select("portfolio").distinct().withColumns({"due": F.to_date(F.lit(end_at)), "terminal": F.lit(True)})
    due = signals.filter(F.col("signal_at") < F.to_date(F.lit(end_at))).select("portfolio", F.date_add("signal_at", rules.lag_days).alias("due"), F.lit(False).alias("terminal")).distinct()
    days = asof_join(due.unionByName(last).withColumn("all", F.lit(1)), calendar, ["all"], "due", "day", ["execution_at"], forward=True)
    stepped = days.withColumn("execution_at", F.coalesce("execution_at", "due")).withColumn("step", F.row_number().over(Window.partitionBy("portfolio").orderBy("due", "terminal")))
    wanted = signals.filter(F.col("rank") <= rules.top_n)
    names = wanted.select("portfolio", "ticker").distinct()
    ranks = wanted.select("portfolio", "ticker", F.date_add("signal_at", rules.lag_days).alias("due"), "rank", F.lit(False).alias("terminal"))
    asked = stepped.select("portfolio", "step", "due", "terminal", "execution_at").join(names, "portfolio").join(ranks, ["portfolio", "ticker", "due", "terminal"], "left")
    seen = asof_join(asked, _of_names(prices, names).withColumn("seen_at", F.col("at")), ["ticker"], "execution_at", "at", ["close", "volume", "seen_at"])
    today = F.col("seen_at") == F.col("execution_at")
    shaped = seen.select(
        "portfolio", "step", "execution_at", "terminal", "ticker", F.col("rank").cast("double").alias("rank"), F.when(today, F.col("close")).alias("exact"), F.col("close").alias("mark"), F.when(today, F.col("volume")).alias("volume"),
    )
    return shaped.groupBy("portfolio").applyInPandas(lambda pdf: simulate(pdf, rules), STEPS)


def rebalances(steps: DataFrame) -> DataFrame:
    """One row a step."""
    named = [c.split()[0] for c in STEPS.split(", ") if c.split()[0] not in ("ticker", "units")]
    return steps.select(*named).distinct()


def equity(steps: DataFrame, prices: DataFrame) -> DataFrame:
    """``(portfolio, at, value, drawdown)``: every step, and every day between on which a held name has a price; the last point of a day wins."""
    order = Window.partitionBy("portfolio").orderBy("step")
    points = rebalances(steps).withColumn("until", F.lead("execution_at").over(order))
    held = steps.filter("ticker is not null").join(points.select("portfolio", "step", "until"), ["portfolio", "step"]).filter("until is not null")
    holding = held.select("portfolio", "step", "ticker", "units", "cash", "execution_at", "until")
    own = _of_names(prices, holding)
    marks = own.select("ticker", F.col("at").alias("day")).join(holding, "ticker").filter((F.col("day") > F.col("execution_at")) & (F.col("day") < F.col("until"))).select("portfolio", "step", "day").distinct()
    priced = asof_join(marks.join(holding.drop("execution_at", "until"), ["portfolio", "step"]), own, ["ticker"], "day", "at", ["close"])
    valued = priced.groupBy("portfolio", "step", "day").agg((F.max("cash") + F.sum(F.col("units") * F.col("close"))).alias("value"))
    every = valued.select("portfolio", F.col("day").alias("at"), "value").unionByName(points.select("portfolio", F.col("execution_at").alias("at"), F.col("post_value").alias("value")))
    so_far = Window.partitionBy("portfolio").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("drawdown", F.col("value") / F.max("value").over(so_far) - 1)


def performance(curve: DataFrame, steps: DataFrame, capital: float) -> DataFrame:
    """Total and yearly return, yearly volatility, deepest drawdown, mean turnover and costs of each portfolio."""
    order = Window.partitionBy("portfolio").orderBy("at")
    moved = curve.withColumns({"before": F.lag("value").over(order), "days": F.datediff("at", F.lag("at").over(order))})
    change = F.when((F.col("days") > 0) & (F.col("before") > 0), F.col("value") / F.col("before") - 1)
    sums = moved.groupBy("portfolio").agg(
        F.max_by("value", "at").alias("ending"), F.datediff(F.max("at"), F.min("at")).alias("elapsed"), F.stddev_samp(change).alias("deviation"), F.avg(F.when(change.isNotNull(), F.col("days"))).alias("gap"), F.min("drawdown").alias("deepest"),
    )
    paid = rebalances(steps).groupBy("portfolio").agg(F.avg(F.when(~F.col("status").isin("SETTLED", "FORCED_SETTLEMENT"), F.col("turnover"))).alias("turnover"), F.sum("cost").alias("costs"))
    grown = F.col("ending") / capital
    yearly = F.when((F.col("elapsed") > 0) & (grown > 0), F.pow(grown, 365.25 / F.when(F.col("elapsed") > 0, F.col("elapsed"))) - 1)
    return sums.join(paid, "portfolio").select("portfolio", (grown - 1).alias("total_return"), yearly.alias("cagr"), (F.col("deviation") * F.sqrt(365.25 / F.col("gap"))).alias("volatility"), "deepest", "turnover", "costs")
