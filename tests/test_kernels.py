"""Valuation kernels and budgets by hand and by their invariants."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import budget as B
from tidemark.operators import valuation as V

BASE = {"revenue": 100.0, "nopat": 10.0, "growth": 0.06, "margin": 0.10, "target": 0.11, "roiic": 0.15, "wacc": 0.105, "stable_growth": 0.02, "stable_margin": 0.10, "stable_roic": 0.105}


def plain(a, years=10, cap=5, fade=3, converge=3):
    """Economic value by a plain loop."""
    revenue, before, pv = a["revenue"], a["nopat"], 0.0
    for t in range(1, years + 1):
        target = a["margin"] + (a["target"] - a["margin"]) * min(t / converge, 1)
        share = 0 if t <= cap else min((t - cap) / fade, 1) if fade else 1
        mix = lambda x, y, share=share: x + (y - x) * share
        revenue *= 1 + mix(a["growth"], a["stable_growth"])
        nopat = revenue * mix(target, a["stable_margin"])
        pv += (nopat - max(nopat - before, 0) / mix(a["roiic"], a["stable_roic"])) / (1 + a["wacc"]) ** t
        before = nopat
    last = revenue * (1 + a["stable_growth"]) * a["stable_margin"] * (1 - a["stable_growth"] / a["stable_roic"]) / (a["wacc"] - a["stable_growth"])
    return pv + last / (1 + a["wacc"]) ** years


def value(spark, rows, cap=5, fade=3):
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["i", *BASE])
    core = V.economic_core({k: F.col(k) for k in BASE}, 10, F.lit(cap), F.lit(fade), 3)
    return [r["v"] for r in df.withColumn("c", core).select("i", (F.col("c.pv") + F.col("c.terminal")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("cap,fade", [(5, 3), (0, 0), (10, 0), (2, 8)])
def test_economic_value_equals_a_loop(spark, cap, fade):
    rows = [BASE, BASE | {"growth": -0.05}, BASE | {"target": 0.05}, BASE | {"nopat": -5.0}]
    assert value(spark, rows, cap, fade) == pytest.approx([plain(r, cap=cap, fade=fade) for r in rows])


@pytest.mark.parametrize("driver,up,steps", [("roiic", True, 0.01), ("wacc", False, 0.005), ("stable_roic", True, 0.01), ("stable_margin", True, 0.005), ("growth", True, 0.01)])
def test_value_moves_one_way_with_each_driver(spark, driver, up, steps):
    """Twenty steps of a driver move the value in one direction; growth adds value as returns exceed the cost of capital."""
    got = value(spark, [BASE | {driver: BASE[driver] + k * steps} for k in range(20)])
    assert got == sorted(got, reverse=not up)


def test_other_kernels_by_hand(spark):
    one = spark.range(1)
    lit = lambda *x: F.array(*map(F.lit, x))
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (0.1, 2.0), (0.2, 1.0), (0.3, 5.0))))
    r = one.select(
        V.discounted(lit(10.0, 20.0), F.lit(0.1)).alias("d"), V.gordon(F.lit(5.0), F.lit(0.02), F.lit(0.03)).alias("none"), V.adjusted_present_value(lit(10.0), F.lit(11.0), lit(1.0), F.lit(0.1), F.lit(0.05), F.lit(0.0), F.lit(2.0)).alias("apv"),
        V.residual_income(F.lit(100.0), F.lit(0.1), F.lit(0.1), F.lit(0.1), 0.4, 0.02, 5).alias("rim"), V.survived(F.lit(100.0), F.lit(0.2), F.lit(10.0)).alias("s"),
        V.crossing(points, F.lit(1.5), F.lit(0.0)).alias("near"), V.crossing(points, F.lit(1.5), F.lit(0.3)).alias("far"), V.crossing(points, F.lit(9.0), F.lit(0.0)).alias("high"), V.crossing(points, F.lit(0.5), F.lit(0.0)).alias("low"),
    ).first()
    assert r["d"] == pytest.approx(10 / 1.1 + 20 / 1.21) and r["none"] is None and r["s"] == pytest.approx(82)
    assert r["apv"] == pytest.approx(10 / 1.1 + 110 / 1.1 + 1 / 1.05 - 2) and r["rim"] == pytest.approx(100)
    assert (r["near"]["status"], r["near"]["x"]) == ("SOLVED", pytest.approx(0.05)) and r["far"]["x"] == pytest.approx(0.2 + 0.1 * 0.5 / 4)
    assert r["high"]["status"] == "CENSORED_HIGH" and r["low"]["status"] == "CENSORED_LOW" and r["low"]["x"] is None
    g = spark.createDataFrame([(50.0, 80.0), (0.0, 80.0)], "a double, b double").select(V.geometric(("a", 0.4), ("b", 0.6)).alias("g")).collect()
    assert [x["g"] for x in g] == [pytest.approx(100 * math.pow(0.5, 0.4) * math.pow(0.8, 0.6)), 0.0]


def test_budget_takes_minimums_first(spark):
    rows = [("d", i, role, tokens, rel) for i, (role, tokens, rel) in enumerate([("A", 50, 0.9), ("A", 50, 0.8), ("B", 60, 0.1), ("C", 30, None), ("B", 10, 0.9)])]
    df = spark.createDataFrame(rows, "document string, position int, role string, tokens int, relevance double")
    got = {r["position"]: r["taken"] for r in B.within_budget(df, 130, {"A": 1.0, "B": 0.5}, {"B": 15}).collect()}
    # B: 10 tokens are under 15, so the next one of B goes in too; then the best that fits
    assert got == {4: True, 2: True, 0: True, 1: False, 3: False}
    assert not B.choose(pd.DataFrame({"role": ["A"], "tokens": [10], "relevance": [1.0]}), 5, {}, {}).any()


def test_batches_end_before_they_overflow(spark):
    r = spark.range(1).select(B.batches(F.array(*map(F.lit, (5, 5, 1, 20, 3, 8))), 10).alias("b"), B.batches(F.array().cast("array<int>"), 10).alias("none")).first()
    assert r["b"] == [0, 0, 1, 2, 3, 4] and r["none"] == []
