"""States carried forward, by hand and over a stream, and quantiles by weight."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators.ranks import weighted_quantiles
from tidemark.plans.states import graded
from tidemark.sources.tables import table
from tidemark.streaming.grounded import grounded, grounded_stream

ARGS = (["user_id", "event_type"], "ts", "state", "confidence", "event_id")


def test_by_hand(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    rows = [("a", day(1), 3, 0.9, 1), ("a", day(3), 5, 0.4, 2), ("a", day(3), 4, 0.8, 3), ("a", day(4), 4, None, 4), ("a", day(20), 1, 0.5, 5), ("b", day(1), 1, 0.1, 6), (None, day(1), 1, 0.1, 7), ("a", None, 1, 0.1, 8), ("a", day(21), None, 0.1, 9), ("a", day(22), 0, 0.7, 10)]
    df = spark.createDataFrame(rows, "k string, t timestamp, s int, c double, i int")
    got = {r["id"]: (r["prior_id"], r["age_days"], r["direction"], r["confidence"], r["reason"]) for r in grounded(df, ["k"], "t", "s", "c", "i", 2).collect()}
    assert got == {
        1: (None, None, None, None, "ONE_PERIOD_ONLY"), 2: (1, 2, 1, 0.4, None), 3: (1, 2, 1, 0.8, None), 4: (3, 1, 0, 0.8, None), 5: (None, None, None, None, "STALE_PRIOR_STATE"),
        6: (None, None, None, None, "ONE_PERIOD_ONLY"), 10: (5, 2, -1, 0.5, None),
    }
    assert grounded(df.limit(0), ["k"], "t", "s", "c", "i", 2).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Three files in the order of time, one to a batch."""
    batch = graded(table(spark, "/root/testdata/sf0.001", "events")).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "state", "confidence", "event_id")
    cuts = batch.agg(F.percentile(F.unix_micros("ts"), F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    for k, (low, high) in enumerate(((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 2**62))):
        batch.filter((F.unix_micros("ts") > low) & (F.unix_micros("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = grounded_stream(stream, *ARGS, 2).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got, want = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())), sorted(map(str, grounded(batch, *ARGS, 2).collect()))
    assert got == want and {r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {None, "ONE_PERIOD_ONLY", "STALE_PRIOR_STATE"}


def test_weighted_quantiles(spark):
    rows = [("a", 1.0, Decimal(1)), ("a", 2.0, Decimal(1)), ("a", 2.0, Decimal(1)), ("a", 9.0, Decimal(7)), ("a", None, Decimal(5)), ("a", 3.0, None), ("b", 4.0, Decimal(0))]
    got = {r["g"]: tuple(r)[1:] for r in weighted_quantiles(spark.createDataFrame(rows, "g string, v double, w decimal(10,2)"), "v", "w", ["g"], {"a": 0, "b": 10, "c": 30, "d": 31, "e": 100}).collect()}
    assert got == {"a": (1.0, 1.0, 2.0, 9.0, 9.0), "b": (4.0,) * 5}
