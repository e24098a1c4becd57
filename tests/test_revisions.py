"""Roots of curves by hand: several, at points, flat stretches, and prices outside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.valuation import curve_roots, economic_core, economic_values, frozen_revision

POINT = "array<struct<x:double,y:double>>"


def test_roots(spark):
    curve = [(0.0, 1.0), (1.0, 3.0), (2.0, 3.0), (3.0, 0.0), (4.0, 2.0)]
    df = spark.createDataFrame([(k, curve, p) for k, p in enumerate((2.0, 3.0, 1.0, 0.0, 9.0, None))] + [(6, [], 1.0), (7, [(1.0, 2.0)], 2.0)], f"k int, c {POINT}, p double")
    got = {r["k"]: [tuple(x) for x in r["r"]] for r in df.select("k", curve_roots(F.col("c"), F.col("p")).alias("r")).collect() if r["r"] is not None}
    # a price met at the last point ends its segment and is a root of its own
    assert got[0] == [(0.5, 0.0, 1.0), (pytest.approx(2 + 1 / 3), 2.0, 3.0), (4.0, 3.0, 4.0), (4.0, 4.0, 4.0)]
    assert [x[0] for x in got[1]] == [1.0, 1.0, 2.0] and got[1][1] == (1.0, 1.0, 1.0)
    assert [x[0] for x in got[2]][0] == 0.0 and got[4] == [] and not got.get(5)
    assert got[7] == [(1.0, 1.0, 1.0)]


def test_revision_follows_the_branch(spark):
    curve = [(0.0, 0.0), (1.0, 4.0), (2.0, 0.0)]
    rows = [("up", curve, 0.1, 2.0, 3.0), ("down", curve, 1.9, 2.0, 3.0), ("out", curve, 0.1, 5.0, 3.0), ("later", curve, 0.1, 2.0, 5.0), ("short", [(0.0, 2.0)], 0.1, 2.0, 2.0), ("none", None, 0.1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, f"k string, c {POINT}, s double, e double, t double")
    got = {r["k"]: r for r in frozen_revision(df, "c", "s", "e", "t").collect()}
    assert (got["up"]["entry_root"]["x"], got["up"]["target_root"]["x"], got["up"]["revision"]) == (0.5, 0.75, 0.25)
    assert (got["down"]["entry_root"]["x"], got["down"]["revision"]) == (1.5, -0.25)
    assert [got[k]["status"] for k in ("up", "out", "later", "short", "none")] == ["SOLVED", "ENTRY_PRICE_OUTSIDE_CURVE", "TARGET_PRICE_OUTSIDE_CURVE", "NO_ELIGIBLE_CURVE", "NO_ELIGIBLE_CURVE"]
    assert got["later"]["entry_root"]["x"] == 0.5 and got["later"]["revision"] is None and got["none"]["entry_root"] is None


def test_values_on_arrays_are_those_of_expressions(spark):
    draw = np.random.default_rng(3)
    names = ("revenue", "nopat", "margin", "stable_margin", "growth", "target", "roiic")
    columns = {c: draw.uniform(0.01, 0.4, 40) * (1000 if c in ("revenue", "nopat") else 1) for c in names}
    rates = {"wacc": 0.09, "stable_growth": 0.02, "stable_roic": 0.09}
    df = spark.createDataFrame([(k, *(float(columns[c][k]) for c in names)) for k in range(40)], "k int, " + ", ".join(f"{c} double" for c in names))
    for cap, fade in ((0, 0), (5, 3), (10, 0), (8, 3)):
        core = economic_core({c: F.col(c) for c in names} | {c: F.lit(x) for c, x in rates.items()}, 10, F.lit(cap), F.lit(fade), 3)
        want = [r["v"] for r in df.withColumn("c", core).select("k", (F.col("c.pv") + F.col("c.terminal")).alias("v")).orderBy("k").collect()]
        assert economic_values(columns | rates, 10, cap, fade, 3).tolist() == pytest.approx(want, rel=1e-12)
