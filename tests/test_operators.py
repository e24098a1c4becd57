"""Operators on small tables worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, latest_version
from tidemark.operators.components import connected_components
from tidemark.operators.ranks import average_rank, spearman, tail_spread, winsorize

D = dt.date


@pytest.mark.parametrize(("forward", "want"), [(False, [1.0, 2.0, None]), (True, [2.0, None, 9.0])])
def test_asof_join(spark, forward, want):
    left = spark.createDataFrame([("a", D(2025, 1, 5), 0), ("a", D(2025, 1, 9), 1), ("b", D(2025, 1, 1), 2)], "k string, at date, i int")
    right = spark.createDataFrame([("a", D(2025, 1, 1), 1.0), ("a", D(2025, 1, 8), 2.0), ("b", D(2025, 1, 4), 9.0)], "k string, t date, v double")
    out = asof_join(left, right, ["k"], "at", "t", ["v"], forward=forward).orderBy("i").collect()
    assert [r["v"] for r in out] == want
    late = asof_join(left, right, ["k"], "at", "t", ["v"], forward=forward, within_days=0).collect()
    assert {r["v"] for r in late} == {None}


def test_asof_join_sees_the_same_day(spark):
    left = spark.createDataFrame([("a", D(2025, 1, 1))], "k string, at date")
    right = spark.createDataFrame([("a", D(2025, 1, 1), 1.0)], "k string, t date, v double")
    for forward in (False, True):
        assert asof_join(left, right, ["k"], "at", "t", ["v"], forward=forward).first()["v"] == 1.0


def test_versions_known_at_the_cutoff(spark):
    rows = spark.createDataFrame([("x", D(2020, 3, 30), 1), ("x", D(2020, 4, 1), 2)], "k string, at date, v int")
    for cutoff, want in (("2020-03-31", 1), ("2020-04-02", 2)):
        assert latest_version(rows, ["k"], "at", "v", F.to_date(F.lit(cutoff))).first()["v"] == want
    assert latest_version(rows, ["k"], "at", "v", F.to_date(F.lit("2019-01-01"))).count() == 0


def test_ranks_spread_and_correlation(spark):
    rows = spark.createDataFrame([("d", i, float(i), i / 10) for i in range(10)], "d string, id int, s double, r double")
    got = tail_spread(rows.withColumn("k", F.col("id").cast("string")), "s", "r", ["d"], "k").first()
    assert got["tail_n"] == 2 and got["spread"] == pytest.approx(0.8)
    assert spearman(rows, "s", "r", ["d"]).first()["ic"] == pytest.approx(1.0)
    assert spearman(rows.filter("id < 4"), "s", "r", ["d"]).first()["ic"] is None
    assert spearman(rows.withColumn("s", F.lit(1.0)), "s", "r", ["d"]).first()["ic"] is None
    tied = rows.withColumn("s", F.when(F.col("id") < 2, 0.0).otherwise(F.col("s"))).select("id", average_rank("s", ["d"]).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in tied][:3] == [1.5, 1.5, 3.0]


def test_winsorize_keeps_nulls(spark):
    rows = spark.createDataFrame([("d", float(i)) for i in range(101)] + [("d", None)], "d string, v double")
    got = winsorize(rows, "v", ["d"]).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.count("*").alias("all")).first()
    assert (got["lo"], got["hi"], got["n"], got["all"]) == (1.0, 99.0, 101, 102)


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, None)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0
