"""The panel's step over prices against plain loops, and regressions that share their passes."""

import bisect
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regression
from tidemark.plans import views

SF = "/root/testdata/sf0.001"
HOLD, STALE = 77, 10


def test_days_that_count_alike_are_one_row(spark):
    beside = views.prices(spark, SF).crossJoin(views.signal_dates(spark)).withColumn("back", F.datediff("signal_date", "price_date")).filter("back between -77 and 363")
    near = views.near_prices(spark, SF, (0, STALE), (-HOLD, STALE - HOLD))
    assert near.count() < 0.75 * beside.count()
    assert views.near_prices(spark, SF).count() < 0.5 * beside.filter("back >= 0").count()


def test_held_signals_are_those_of_a_loop(spark):
    by_name = defaultdict(dict)
    for r in views.prices(spark, SF).collect():
        by_name[r["ticker"]][r["price_date"]] = (r["close"], r["amount"])
    dates = [r["signal_date"] for r in views.signal_dates(spark).collect()]
    want = {}
    for ticker, seen in by_name.items():
        order = sorted(seen)
        for s in dates:
            now = [seen[d][1] for d in order if 0 <= (s - d).days < 182]
            before = [seen[d][1] for d in order if 182 <= (s - d).days < 364]
            if not now or not before or sum(before) <= 0:
                continue
            closes = []
            for at in (s, s + timedelta(days=HOLD)):
                k = bisect.bisect_right(order, at) - 1
                closes.append(seen[order[k]][0] if k >= 0 and (at - order[k]).days <= STALE else None)
            want[s, ticker] = (round(sum(now) / sum(before) - 1, 6), *closes)
    got = {(r["signal_date"], r["ticker"]): (r["signal"], r["entry_close"], r["exit_close"]) for r in views.held_signals(spark, SF, HOLD, STALE).collect()}
    assert set(got) == set(want) and len(want) > 100
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=2e-6)


def test_a_ticker_is_one_number(spark):
    keys = [0, 7, 999999, 1000000, 1234567, 123456, 12345678901, -5, -99999, -100000, -1234567, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("number", views._number("k"))
    got = rows.select(views._ticker("k").alias("t"), views._ticker("number").alias("n"), "number").collect()
    assert all(r["t"] == r["n"] for r in got)
    assert len({r["t"] for r in got}) == len({r["number"] for r in got})


def test_hundredths_are_those_of_decimals(spark):
    values = [0.0, 1.005, 2.675, -1.005, 0.1 + 0.2, 98765432.1, -0.004, 50.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(views._hundredths("v").alias("h"), (F.col("v").cast("decimal(18,2)") * 100).cast("long").alias("d")).collect()
    assert [r["h"] for r in rows] == [r["d"] for r in rows]


def test_specifications_that_leave_out_the_same_rows_share_a_pass(spark, monkeypatch):
    rows = [(f"u{i % 7}", date(2000, 1, 1 + i % 5), float(i * i % 11), float(i % 9), float(i * 5 % 13), None if i % 6 == 0 else float(i * 3 % 8)) for i in range(60)]
    df = spark.createDataFrame(rows, "unit string, period date, y double, x double, a double, b double")
    specs = {"none": [], "a": ["a"], "b": ["b"], "both": ["a", "b"]}
    written = []
    keep = regression.materialize
    monkeypatch.setattr(regression, "materialize", lambda df, name: written.append(name) or keep(df, name))
    got = {r["specification"]: r for r in regression.panel_regressions(df, "y", "x", specs, "unit", "period").collect()}
    assert sorted(written) == ["cells", "cells", "panel", "periods", "periods"]
    for name, controls in specs.items():
        alone = regression.panel_regression(df, "y", "x", controls, "unit", "period").first()
        assert [got[name][c] for c in alone.asDict()] == pytest.approx(list(alone), rel=1e-9)
    assert got["b"]["n"] == 50 and got["a"]["n"] == 60
