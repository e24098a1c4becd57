"""Inference, interval joins and streams on small tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators.inference import holm, interval_join, newey_west, rank_bucket, residual, two_sided_p
from tidemark.sources.tables import table
from tidemark.streaming import events as streams

D = dt.date


def test_newey_west_by_hand(spark):
    values = [1.0, 3.0, 2.0, 6.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 5.0), ("a", 9, None)], "k string, i int, v double")
    got = {r["k"]: r for r in newey_west(rows, "v", "i", ["k"], 2).collect()}
    mean = sum(values) / 4
    e = [v - mean for v in values]
    cov = [sum(e[t] * e[t - k] for t in range(k, 4)) / 4 for k in range(3)]
    se = math.sqrt((cov[0] + 2 * (2 / 3 * cov[1] + 1 / 3 * cov[2])) / 4)
    assert got["a"]["n"] == 4 and got["a"]["se"] == pytest.approx(se) and got["a"]["t"] == pytest.approx(mean / se)
    assert got["b"]["n"] == 1 and got["b"]["t"] is None


def test_holm_and_p_values(spark):
    rows = spark.createDataFrame([("d", k, p) for k, p in (("x", 0.01), ("y", 0.04), ("z", 0.03), ("u", None))], "d string, k string, p double")
    got = {r["k"]: r["adjusted"] for r in holm(rows, "p", ["d"], "k").collect()}
    assert got == pytest.approx({"x": 0.03, "z": 0.06, "y": 0.06})
    p = spark.range(1).select(two_sided_p(F.lit(-1.959964)).alias("p")).first()["p"]
    assert p == pytest.approx(0.05, abs=2e-7)


def test_residual_and_buckets(spark):
    rows = spark.createDataFrame([("d", i, float(i), 2.0 * i + 1) for i in range(10)] + [("one", 0, 1.0, 4.0)], "d string, i int, x double, y double")
    got = rows.select("d", residual("y", "x", ["d"]).alias("e"), rank_bucket("x", ["d"], "i", 5).alias("q"), "i").orderBy("d", "i").collect()
    assert [r["e"] for r in got] == pytest.approx([0.0] * 11, abs=1e-9)
    assert [r["q"] for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 1]


def test_interval_join_needs_publication(spark):
    right = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 12, 31), D(2020, 1, 10), "old"), ("a", D(2021, 1, 1), None, D(2021, 2, 1), "new")], "k string, s date, e date, p date, v string")
    left = spark.createDataFrame([("a", D(2020, 1, 5)), ("a", D(2020, 6, 1)), ("a", D(2021, 1, 15)), ("a", D(2022, 1, 1)), ("b", D(2020, 6, 1))], "k string, at date")
    got = {(r["k"], str(r["at"])): r["v"] for r in interval_join(left, right, ["k"], "at", "s", "e", "p", ["v"]).collect()}
    assert got == {("a", "2020-01-05"): None, ("a", "2020-06-01"): "old", ("a", "2021-01-15"): None, ("a", "2022-01-01"): "new", ("b", "2020-06-01"): None}
    twice = interval_join(left.unionByName(left), right, ["k"], "at", "s", "e", "p", ["v"])
    assert twice.count() == 10


@pytest.mark.parametrize("form", [streams.hourly, streams.sessions, streams.first_of_hour])
def test_stream_gives_the_closed_rows_of_the_batch(spark, tmp_path, form):
    batch = table(spark, "/root/testdata/sf0.001", "events")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = form(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in form(batch).collect()}
    assert got <= want and len(got) > len(want) // 2
