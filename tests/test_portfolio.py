"""Backtests by hand: rotation, locks, costs, settlement, capacity and marks."""

import datetime as dt

import pandas as pd
import pytest

from tidemark.operators import portfolio as P

FREE = {"cost_bps": 0.0, "slippage_bps": 0.0, "capital": 1000.0}
PRICES = [("AAA", "2025-01-02", 100), ("BBB", "2025-01-02", 50), ("AAA", "2025-02-02", 110), ("BBB", "2025-02-02", 50), ("AAA", "2025-03-02", 120), ("BBB", "2025-03-02", 60)]


def run(spark, signals, prices, rules, end="2025-03-01"):
    s = spark.createDataFrame([("p", dt.date.fromisoformat(d), t, k) for d, t, k in signals], "portfolio string, signal_at date, ticker string, rank int")
    p = spark.createDataFrame([(t, dt.date.fromisoformat(d), float(c), 1e6) for t, d, c in prices], "ticker string, at date, close double, volume double")
    return P.backtest(s, p, end, rules), p


def test_rotates_at_the_next_day_with_prices(spark):
    steps, prices = run(spark, [("2025-01-01", "AAA", 1), ("2025-02-01", "BBB", 1)], PRICES, P.Rules(top_n=1, **FREE))
    got = P.rebalances(steps).orderBy("step").collect()
    assert [(str(r["execution_at"]), round(r["post_value"], 6)) for r in got] == [("2025-01-02", 1000), ("2025-02-02", 1100), ("2025-03-02", 1320)]
    assert [r["status"] for r in got] == ["OK", "OK", "SETTLED"]
    curve = P.equity(steps, prices)
    assert curve.agg({"drawdown": "min"}).first()[0] == 0
    out = P.performance(curve, steps, 1000.0).first()
    assert abs(out["total_return"] - 0.32) < 1e-12 and abs(out["cagr"] - (1.32 ** (365.25 / 59) - 1)) < 1e-12


def test_costs_take_from_the_value(spark):
    steps, _ = run(spark, [("2025-01-01", "AAA", 1)], PRICES, P.Rules(top_n=1, cost_bps=100.0, slippage_bps=0.0, capital=1000.0))
    first, last = P.rebalances(steps).orderBy("step").collect()
    assert abs(first["cost"] - 10) < 1e-9 and abs(first["post_value"] - 990) < 1e-9
    assert abs(last["post_value"] - 990 * 1.2 * 0.99) < 1e-9


def test_a_name_without_a_price_is_locked(spark):
    prices = [x for x in PRICES if x[:2] != ("AAA", "2025-02-02")]
    steps, _ = run(spark, [("2025-01-01", "AAA", 1), ("2025-02-01", "BBB", 1)], prices, P.Rules(top_n=1, **FREE))
    second = steps.filter("step = 2").orderBy("ticker").collect()
    assert [(r["ticker"], round(r["units"], 9)) for r in second] == [("AAA", 10.0), ("BBB", 0.0)]
    assert second[0]["locked"] == 1 and second[0]["selected"] == 1 and abs(second[0]["turnover"]) < 1e-12
    assert abs(steps.filter("step = 3").first()["post_value"] - 1200) < 1e-9


def test_settlement_without_an_exit_price(spark):
    steps, _ = run(spark, [("2025-01-01", "AAA", 1)], [("AAA", "2025-01-02", 100), ("BBB", "2025-03-02", 1)], P.Rules(top_n=1, **FREE))
    last = steps.filter("step = 2").first()
    assert last["post_value"] == 0 and last["status"] == "FORCED_SETTLEMENT" and last["locked"] == 1


def test_capacity_and_marks(spark):
    prices = [("AAA", "2025-01-02", 100), ("AAA", "2025-01-10", 80), ("AAA", "2025-01-20", 90), ("AAA", "2025-03-02", 120)]
    steps, panel = run(spark, [("2025-01-01", "AAA", 1)], prices, P.Rules(top_n=1, cost_bps=0.0, slippage_bps=0.0, capital=1e5))
    assert steps.filter("step = 1").first()["status"] == "OVER_CAPACITY" and abs(steps.filter("step = 1").first()["utilization"] - 0.1) < 1e-12
    got = [(str(r["at"]), r["value"], round(r["drawdown"], 6)) for r in P.equity(steps, panel).orderBy("at").collect()]
    assert got == [("2025-01-02", 1e5, 0), ("2025-01-10", 8e4, -0.2), ("2025-01-20", 9e4, -0.1), ("2025-03-02", 1.2e5, 0)]


@pytest.mark.parametrize("requested", [["A", "B"], []])
def test_turnover_of_a_step(requested):
    rows = [("p", 1, dt.date(2025, 1, 1), False, t, float(i) if t in requested else None, 10.0, 10.0, 1e6) for i, t in enumerate("AB", 1)]
    out = P.simulate(pd.DataFrame(rows, columns=["portfolio", "step", "execution_at", "terminal", "ticker", "rank", "exact", "mark", "volume"]), P.Rules(capital=100.0))
    assert out["turnover"].iloc[0] == (1.0 if requested else 0.0) and len(out) == max(1, len(requested))


def test_only_prices_of_named_securities_are_followed(spark):
    """Other names give execution days, but none of their prices reaches the steps or the marks."""
    others = [("ZZZ", "2025-01-02", 1), ("YYY", "2025-02-02", 1), ("ZZZ", "2025-02-10", 9)]
    signals = [("2025-01-01", "AAA", 1), ("2025-02-01", "BBB", 1)]
    steps, prices = run(spark, signals, PRICES + others, P.Rules(top_n=1, **FREE))
    curve = P.equity(steps, prices)
    assert "LeftSemi" in steps._jdf.queryExecution().optimizedPlan().toString() and "LeftSemi" in curve._jdf.queryExecution().optimizedPlan().toString()
    alone, own = run(spark, signals, PRICES, P.Rules(top_n=1, **FREE))
    assert sorted(map(tuple, curve.collect())) == sorted(map(tuple, P.equity(alone, own).collect()))
