"""Vintages by hand: a year without a row, null spending, and zero bases."""

import pytest

from tidemark.operators.capital import capital_profile, capital_returns

ROW = "k string, y int, nopat double, capital double, reinvestment double, research double, sga double, acquisitions double, buybacks double, dividends double"


def test_vintages(spark):
    rows = [("a", 2018, 10.0, 100.0, 5.0, 30.0, 20.0, 1.0, None, 2.0), ("a", 2019, 12.0, 100.0, 4.0, None, 20.0, 1.0, None, 2.0), ("a", 2021, 0.0, 0.0, 0.0, 9.0, None, 1.0, None, 2.0), ("a", 2022, 3.0, 50.0, 1.0, 0.0, 0.0, None, None, None), ("b", 2020, 1.0, 10.0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    got = {(r["k"], r["y"]): r for r in capital_returns(df, ["k"], "y", life=3, tax=0.25, overhead=0.5).collect()}
    spent = {2018: 40.0, 2019: 10.0, 2021: 9.0, 2022: 0.0}
    for y in spent:
        am = sum(v for s, v in spent.items() if 1 <= y - s <= 3) / 3
        asset = sum(v * (3 - (y - s)) / 3 for s, v in spent.items() if 0 <= y - s <= 2)
        assert got["a", y]["amortization"] == pytest.approx(am) and got["a", y]["asset"] == pytest.approx(asset)
    assert got["a", 2018]["roiic"] is None and got["a", 2019]["roiic"] == pytest.approx(2 / 4) and got["a", 2021]["roiic"] is None and got["a", 2021]["adjusted_roiic"] is None and got["a", 2021]["roic"] is None
    an = {2018: 10 + 40 * 0.75, 2019: 12 + (10 - 40 / 3) * 0.75}
    assert got["a", 2019]["adjusted_roiic"] == pytest.approx((an[2019] - an[2018]) / (4 + 10 - 40 / 3))
    assert got["b", 2020]["roic"] == 0.1 and got["b", 2020]["reinvestment_rate"] is None
    told = {r["k"]: r for r in capital_profile(capital_returns(df, ["k"], "y", 3, 0.25, 0.5), df, ["k"], "y").collect()}
    assert told["a"]["periods"] == 4 and told["a"]["acquisitions"] == 3.0 and told["a"]["buybacks"] == 0 and told["a"]["latest_roiic"] == pytest.approx(3.0)
    assert told["b"]["latest_roiic"] is None and told["b"]["dividends"] == 0
    assert capital_returns(df.limit(0), ["k"], "y").count() == 0
