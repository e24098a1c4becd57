"""States carried forward, and quantiles by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import weighted_quantiles
from tidemark.sources.tables import table
from tidemark.streaming.grounded import grounded

LIMIT_DAYS = 2


def graded(rows: DataFrame) -> DataFrame:
    """Events with the tens of their value as a state, and its fraction as a confidence."""
    return rows.withColumns({"state": F.floor(F.col("value") / 10), "confidence": F.round(F.abs(F.col("value") - F.floor("value")), 6)})


def last_grounded(spark, sf_dir: str) -> DataFrame:
    """How each user's state of each type has moved since the event before, if that is recent."""
    out = grounded(graded(table(spark, sf_dir, "events")), ["user_id", "event_type"], "ts", "state", "confidence", "event_id", LIMIT_DAYS)
    return out.select("user_id", "event_type", "id", "prior_id", "age_days", "direction", "confidence", "reason")


def price_quantiles(spark, sf_dir: str) -> DataFrame:
    """Each part's prices up to which a tenth, half and nine tenths of its quantity were sold."""
    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("decimal(18,2)"))
    return weighted_quantiles(rows, "l_extendedprice", "w", ["l_partkey"], {"p10": 10, "p50": 50, "p90": 90})


QUERIES = {"last_grounded_state": last_grounded, "weighted_quantiles": price_quantiles}

ORACLE_SQL = {
    "last_grounded_state": """
WITH g AS (SELECT user_id, event_type, ts, event_id AS id, floor(value / 10)::BIGINT AS state, round(abs(value - floor(value)), 6) AS confidence FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY id DESC) = 1),
j AS (SELECT g.*, p.id AS pid, p.state AS ps, p.confidence AS pc, datediff('day', p.ts, g.ts) AS age FROM g ASOF LEFT JOIN l AS p ON g.user_id = p.user_id AND g.event_type = p.event_type AND g.ts > p.ts)
SELECT user_id, event_type, id, CASE WHEN age <= 2 THEN pid END AS prior_id, CASE WHEN age <= 2 THEN age END AS age_days, CASE WHEN age <= 2 THEN sign(state - ps)::BIGINT END AS direction,
  CASE WHEN age <= 2 THEN least(confidence, pc) END AS confidence, CASE WHEN pid IS NULL THEN 'ONE_PERIOD_ONLY' WHEN age > 2 THEN 'STALE_PRIOR_STATE' END AS reason FROM j""",
    "weighted_quantiles": """
WITH s AS (SELECT l_partkey, l_extendedprice AS v, sum(l_quantity::DECIMAL(18,2)) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_partkey ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_partkey) AS t FROM s)
SELECT l_partkey, min(v) FILTER (WHERE 10 * c >= t) AS p10, min(v) FILTER (WHERE 2 * c >= t) AS p50, min(v) FILTER (WHERE 10 * c >= 9 * t) AS p90 FROM r GROUP BY 1""",
}
