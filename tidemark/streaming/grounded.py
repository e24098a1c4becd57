"""How a state has moved since it was last known, unless that is too long ago; over a table and over a stream.

``rows`` have the keys, a timestamp, a whole-number state, a confidence and an
id. A row is compared with the last one of its keys that is strictly earlier:

=====================  ====================================================
reason                 when
=====================  ====================================================
null                   the earlier one is at most ``limit_days`` days old
``ONE_PERIOD_ONLY``    there is none
``STALE_PRIOR_STATE``  it is older
=====================  ====================================================

``direction`` is the sign of the change, ``confidence`` the smaller of the two.
Of several rows at one moment the one with the largest id is the later one's
prior. Rows without a key, timestamp or state are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.shipping import ship_package

COLUMNS = ("prior_id", "age_days", "direction", "confidence", "reason")


def _named(rows: DataFrame, keys: list[str], at: str, state: str, confidence: str, key: str) -> DataFrame:
    told = rows.select(*keys, F.col(at).cast("timestamp").alias("at"), F.col(state).cast("long").alias("state"), F.col(confidence).cast("double").alias("confidence"), F.col(key).cast("long").alias("id"))
    return told.dropna(subset=[*keys, "at", "state"])


def _told(rows: DataFrame, keys: list[str], limit_days: int) -> DataFrame:
    """The result of rows with their ``prior`` (``at``, ``id``, ``state``, ``confidence``)."""
    age = F.datediff("at", "prior.at")
    reason = F.when(F.col("prior").isNull(), "ONE_PERIOD_ONLY").when(age > limit_days, "STALE_PRIOR_STATE")
    grounded = reason.isNull()
    return rows.select(
        *keys, "at", "id", F.when(grounded, F.col("prior.id")).alias("prior_id"), F.when(grounded, age).cast("long").alias("age_days"),
        F.when(grounded, F.signum(F.col("state") - F.col("prior.state")).cast("long")).alias("direction"), F.when(grounded, F.least("confidence", "prior.confidence")).alias("confidence"), reason.alias("reason"),
    )


def grounded(rows: DataFrame, keys: list[str], at: str, state: str, confidence: str, key: str, limit_days: int) -> DataFrame:
    """Over a table: one window over the rows of each key, up to the microsecond before a row."""
    named = _named(rows, keys, at, state, confidence, key).withColumn("_us", F.unix_micros("at"))
    before = Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    return _told(named.withColumn("prior", F.max(F.struct("at", "id", "state", "confidence")).over(before)), keys, limit_days)


def grounded_stream(rows: DataFrame, keys: list[str], at: str, state: str, confidence: str, key: str, limit_days: int) -> DataFrame:
    """Over a stream whose batches come in the order of ``at``: the last row of a key, and of those at its moment's the one before, is its state."""
    ship_package(rows.sparkSession)
    named = _named(rows, keys, at, state, confidence, key)
    kinds = dict(named.dtypes)
    kept = "at timestamp, id long, state long, confidence double"

    def run(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        # the latest row so far, and the latest that is strictly earlier
        last, earlier = (held.get[:4], held.get[4:]) if held.exists else ((None,) * 4, (None,) * 4)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples(index=False):
            row = (r.at, r.id, r.state, r.confidence)
            if last[0] is not None and r.at > last[0]:
                earlier = last
            out.append((*name, *row, *earlier))
            if last[0] is None or row[:2] > last[:2]:
                last = row
        held.update((*last, *earlier))
        yield pd.DataFrame(out, columns=[*keys, "at", "id", "state", "confidence", "p_at", "p_id", "p_state", "p_confidence"]).astype({c: "Int64" for c in ("p_id", "p_state")})

    prior = ", ".join(f"p_{c}" for c in kept.split(", "))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), kept, prior])
    states = ", ".join(f"{p}_{c}" for p in ("last", "earlier") for c in kept.split(", "))
    found = named.groupBy(*keys).applyInPandasWithState(run, schema, states, "append", "NoTimeout")
    told = F.when(F.col("p_at").isNotNull(), F.struct(*(F.col(f"p_{c}").alias(c) for c in ("at", "id", "state", "confidence"))))
    return _told(found.withColumn("prior", told), keys, limit_days)
