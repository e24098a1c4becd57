"""Queries over the price panel, filings, facts, the ledger and sealed sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import market
from tidemark.plans.companies import CUTOFF
from tidemark.plans.views import filings, prices, securities, signals, with_views
from tidemark.sources.stores import active, merge_ledger
from tidemark.sources.tables import table

LEDGER_OPENED, LEDGER_AT = "2023-12-31", "2024-01-15"
#: Days between a first listing and a signal date, the least share of names by amount traded, and the days it is summed over.
LISTED_DAYS, LEAST_LIQUID, TRADED_DAYS = 365, 0.25, 60
#: Order priorities that stand for kinds of debt, and those for parts of a purchase.
DEBT_PARTS = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


def scanned_prices(spark, sf_dir: str) -> DataFrame:
    """The panel as loaded: untradable lines (returned ones) are skipped, and a name's day that is given twice is marked."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    ticker = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    grouped = rows.groupBy(ticker.alias("ticker"), F.to_date("l_shipdate").alias("price_date"))
    order = F.struct("l_orderkey", "l_linenumber")
    return grouped.agg(F.count("*").alias("points"), F.min_by("l_extendedprice", order).alias("close")).withColumn("duplicate", F.col("points") > 1)


def first_timestamps(spark, sf_dir: str) -> DataFrame:
    """The first day with any price at or after each signal date."""
    days = prices(spark, sf_dir).select("price_date").distinct()
    dates = signals(spark, sf_dir).select("signal_date").distinct().withColumn("one", F.lit(1))
    found = market.asof_join(dates, days.withColumn("one", F.lit(1)).withColumn("market_date", F.col("price_date")), ["one"], "signal_date", "price_date", ["market_date"], forward=True)
    return found.select("signal_date", "market_date")


def mark_days(spark, sf_dir: str) -> DataFrame:
    """Days on which any of a market's three names of the largest signal has a price, up to the next signal date."""
    order = Window.partitionBy("market", "signal_date").orderBy(F.desc("signal"), "ticker")
    held = signals(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "market"), "ticker").withColumn("r", F.row_number().over(order)).filter("r <= 3")
    quarter_end = F.last_day(F.add_months(F.trunc("price_date", "quarter"), -1))
    marks = prices(spark, sf_dir).select("ticker", "price_date", quarter_end.alias("signal_date"))
    met = marks.join(held, ["ticker", "signal_date"])
    days = met.groupBy("market", "signal_date", "price_date").agg(F.count_distinct("ticker").alias("names"))
    return days.groupBy("market", "signal_date").agg(F.count("*").alias("marks"), F.count_if(F.col("names") == 3).alias("common"), F.min(F.when(F.col("names") == 3, F.col("price_date"))).alias("first_common"))


def next_signals(spark, sf_dir: str) -> DataFrame:
    """For each filing, the first signal date after the day it became available."""
    end = F.last_day(F.add_months(F.trunc("available_at", "quarter"), 2))
    usable = F.when(end > F.col("available_at"), end).otherwise(F.last_day(F.add_months(end, 3)))
    known = F.greatest(usable, F.lit("1996-03-31").cast("date"))
    return filings(spark, sf_dir).select("issuer", "version", "available_at", F.when(known <= F.lit("2001-12-31").cast("date"), known).alias("usable_at"))


def history(spark, sf_dir: str) -> DataFrame:
    """Each issuer's periods as known at the cutoff, oldest first, with how many versions were seen."""
    seen = filings(spark, sf_dir).filter(F.col("available_at") <= F.lit(CUTOFF).cast("date")).filter(F.col("period_end") <= F.lit(CUTOFF).cast("date"))
    order = F.struct("available_at", "version")
    last = seen.groupBy("issuer", "period_end").agg(F.max_by("revenue", order).alias("revenue"), F.max("available_at").alias("available_at"), F.count("*").alias("versions"))
    return last.withColumn("position", F.row_number().over(Window.partitionBy("issuer").orderBy("period_end")))


def comparables(spark, sf_dir: str) -> DataFrame:
    """Each issuer's latest known period beside the same quarter of the year before."""
    known = history(spark, sf_dir)
    last = known.groupBy("issuer").agg(F.max("period_end").alias("period_end"), F.max_by("revenue", "period_end").alias("revenue"))
    year_ago = F.last_day(F.add_months("period_end", -12))
    prior = known.select("issuer", F.col("period_end").alias("year_ago"), F.col("revenue").alias("prior_revenue"))
    return last.withColumn("year_ago", year_ago).join(prior, ["issuer", "year_ago"], "left").select("issuer", "period_end", "revenue", "prior_revenue", F.round(F.col("revenue") / F.col("prior_revenue") - 1, 6).alias("growth"))


def quarter_pairs(spark, sf_dir: str) -> DataFrame:
    """Pairs of an issuer's first versions where the later period ends exactly one quarter after the earlier."""
    order = F.struct("available_at", "version")
    one = filings(spark, sf_dir).groupBy("issuer", "period_end").agg(F.min_by("revenue", order).alias("revenue"))
    lagged = one.withColumns({n: F.lag(c).over(Window.partitionBy("issuer").orderBy("period_end")) for n, c in (("prior_end", "period_end"), ("prior_revenue", "revenue"))})
    true_next = F.last_day(F.add_months("prior_end", 3)) == F.col("period_end")
    return lagged.filter(true_next).select("issuer", "prior_end", "period_end", F.round(F.col("revenue") / F.col("prior_revenue") - 1, 6).alias("growth"))


def continuity(spark, sf_dir: str) -> DataFrame:
    """Whether an issuer's last positive revenue is within ten times, or a tenth, of the one before."""
    order = Window.partitionBy("issuer").orderBy("period_end")
    rows = history(spark, sf_dir).filter("revenue > 0").withColumn("before", F.lag("revenue").over(order))
    last = rows.groupBy("issuer").agg(F.max_by(F.struct(F.round(F.col("revenue") / F.col("before"), 6).alias("ratio")), "period_end").alias("x"))
    return last.select("issuer", F.col("x.ratio").alias("ratio"), F.coalesce(F.col("x.ratio").between(0.1, 10), F.lit(True)).alias("continuous"))


def eligible(spark, sf_dir: str) -> DataFrame:
    """Names of each date that were listed a year before and are not among the quarter least traded, with their size bucket."""
    first = prices(spark, sf_dir).groupBy("ticker").agg(F.min("price_date").alias("listed"))
    back = F.datediff("signal_date", "price_date")
    near = prices(spark, sf_dir).withColumn("signal_date", F.explode(market.near_signal_dates("price_date", 0, TRADED_DAYS)))
    traded = near.groupBy("signal_date", "ticker").agg(F.round(F.sum("amount"), 2).alias("traded"), F.max_by("close", F.struct(-back, "price_date")).alias("close"))
    date = Window.partitionBy("signal_date")
    share = market.average_rank("traded", ["signal_date"]) / F.count("*").over(date)
    known = traded.withColumn("share", F.round(share, 9)).join(first, "ticker").join(securities(spark, sf_dir).select("ticker", "shares"), "ticker")
    kept = known.filter((F.datediff("signal_date", "listed") >= LISTED_DAYS) & (F.col("share") >= LEAST_LIQUID)).withColumn("size", F.round(F.col("close") * F.col("shares"), 4))
    r, n = F.row_number().over(date.orderBy("size", "ticker")), F.count("*").over(date)
    bucket = F.when(n > 1, F.least(F.lit(3), F.floor((r - 1) * 3 / (n - 1)) + 1)).otherwise(1)
    return kept.select("signal_date", "ticker", F.round("share", 6).alias("share"), bucket.cast("int").alias("bucket"))


def preferred(spark, sf_dir: str) -> DataFrame:
    """One order value for each customer and day of several: consolidated before separate, then without dimensions, then the last one; conflicts are marked."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("issuer"), F.trunc("o_orderdate", "year").alias("period"), F.col("o_totalprice").alias("value"),
        F.struct(F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0), F.col("o_orderpriority") == "5-LOW", F.to_date("o_orderdate"), "o_orderkey").alias("preference"),
    )
    chosen = rows.groupBy("issuer", "period").agg(F.max_by("value", "preference").alias("value"), F.count("*").alias("candidates"), F.count_distinct("value").alias("n"))
    return chosen.select("issuer", F.col("period").cast("date").alias("period"), "value", "candidates", (F.col("n") > 1).alias("conflict"))


def debt(spark, sf_dir: str) -> DataFrame:
    """Total debt by year: the reported total if there is one, else the sum of the parts' sizes, if they agree on a unit."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("issuer"), F.year("o_orderdate").alias("year"))
    amount, kind = F.col("o_totalprice").cast("decimal(14,2)"), F.col("o_orderpriority")
    part = kind.isin(*DEBT_PARTS)
    sums = rows.agg(
        F.sum(F.when(kind == "1-URGENT", amount)).alias("total"), F.sum(F.when(part, amount)).alias("parts"), F.count_distinct(F.when(part, F.col("o_orderstatus"))).alias("units"),
    )
    value = F.coalesce("total", F.when(F.col("units") == 1, F.col("parts")))
    source = F.when(F.col("total").isNotNull(), "REPORTED").when(F.col("units") == 1, "DERIVED").when(F.col("units") > 1, "INCOMPATIBLE_UNITS").otherwise("MISSING")
    return sums.select("issuer", "year", value.cast("double").alias("debt"), source.alias("source"))


def distinct_sizes(spark, sf_dir: str) -> DataFrame:
    """Sum of an order's distinct line amounts, each size once, and the signed amount of the largest size."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(14,2)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", signed.alias("v"))
    return rows.groupBy("l_orderkey").agg(
        F.sum_distinct(F.abs("v")).cast("double").alias("total"), F.max_by("v", F.struct(F.abs("v"), "v")).cast("double").alias("largest"),
    )


def _noticed(spark, sf_dir: str) -> DataFrame:
    """Events as evidence: a user is an issuer, a type of event a piece of evidence."""
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("evidence_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("fact"))


def ledger_active(spark, sf_dir: str) -> DataFrame:
    """Each user's evidence in force at a moment: the last state of every event type that is not a withdrawal, which ends as it begins."""
    seen = _noticed(spark, sf_dir).groupBy("user_id", "event_type", "ticker", "evidence_id").agg(
        F.min("ts").alias("valid_from"), F.max_by("event_id", F.when(F.col("ts") <= F.lit(LEDGER_AT).cast("timestamp"), F.struct("ts", "event_id"))).alias("event_id"), F.count_if(F.col("ts") <= F.lit(LEDGER_AT).cast("timestamp")).alias("seen"),
    )
    ledger = seen.withColumn("valid_to", F.when(F.col("event_type") == "error", F.col("valid_from")))
    return active(ledger, LEDGER_AT).select("user_id", "event_type", "event_id", "seen")


def ledger_merged(spark, sf_dir: str) -> DataFrame:
    """A ledger with a later batch merged in: evidence of the batch is new or seen again, all else is carried."""
    rows = _noticed(spark, sf_dir)
    later, at = F.col("ts") > F.lit(LEDGER_AT).cast("timestamp"), F.lit(LEDGER_AT).cast("timestamp")
    empty = rows.limit(0).select("ticker", "evidence_id", *(F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_to", "last_confirmed_at")), "fact")
    ledger = merge_ledger(merge_ledger(empty, rows.filter(~later), LEDGER_OPENED), rows.filter(later), LEDGER_AT)
    status = F.when(F.col("valid_from") == at, "NEW").when(F.col("last_confirmed_at") == at, "SEEN_AGAIN").otherwise("CARRIED")
    spans = rows.groupBy("user_id", "event_type", "ticker", "evidence_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return spans.join(ledger, ["ticker", "evidence_id"]).select("user_id", "event_type", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")), status.alias("status"))


def sealed(spark, sf_dir: str) -> DataFrame:
    """A digest of each table's rows that no order of rows changes: the hash of the sorted hashes by bucket, then of the buckets."""
    out = None
    for name, columns in (("nation", ("n_nationkey", "n_name")), ("supplier", ("s_suppkey", "s_name")), ("customer", ("c_custkey", "c_name"))):
        rows = table(spark, sf_dir, name).select(F.sha2(F.concat_ws("\t", *columns), 256).alias("h"))
        buckets = rows.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"), F.count("*").alias("n"))
        one = buckets.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("seal")).select(F.lit(name).alias("dataset"), "rows", "seal")
        out = one if out is None else out.unionByName(one)
    return out


def sets_equal(spark, sf_dir: str) -> DataFrame:
    """Names of each pair of consecutive signal dates: how many stay, come and go, and whether the sets are equal."""
    rows = signals(spark, sf_dir).select("signal_date", "ticker")
    after = rows.select(F.last_day(F.add_months("signal_date", 3)).alias("signal_date"), "ticker").withColumn("was", F.lit(1))
    both = rows.withColumn("now", F.lit(1)).join(after, ["signal_date", "ticker"], "full")
    sums = both.groupBy("signal_date").agg(*(F.count_if(c).alias(n) for n, c in (
        ("stayed", F.col("now").isNotNull() & F.col("was").isNotNull()), ("came", F.col("was").isNull()), ("went", F.col("now").isNull()))))
    return sums.withColumns({"equal": (F.col("came") == 0) & (F.col("went") == 0), "jaccard": F.round(F.col("stayed") / (F.col("stayed") + F.col("came") + F.col("went")), 8)})


def ticker_seal(spark, sf_dir: str) -> DataFrame:
    """A digest of each date's set of names."""
    rows = signals(spark, sf_dir).groupBy("signal_date")
    return rows.agg(F.count("*").alias("names"), F.sha2(F.array_join(F.array_sort(F.collect_set("ticker")), "\n"), 256).alias("seal"))


QUERIES = {
    "price_scan_dedup": scanned_prices,
    "market_first_timestamp": first_timestamps,
    "price_mark_timestamps": mark_days,
    "next_usable_signal": next_signals,
    "pit_history": history,
    "pit_comparables": comparables,
    "quarter_pairs": quarter_pairs,
    "revenue_continuity": continuity,
    "universe_eligible": eligible,
    "facts_preferred": preferred,
    "debt_fallback": debt,
    "distinct_abs_sum": distinct_sizes,
    "ledger_active_asof": ledger_active,
    "ledger_merge": ledger_merged,
    "dataset_seal_hash": sealed,
    "set_equality_check": sets_equal,
    "ticker_set_seal": ticker_seal,
}

_SIGNALS = with_views("prices", "dates", "signals")
_HISTORY = with_views("filings") + f""",
hs AS (SELECT issuer, period_end, arg_max(revenue, (available_at, version)) AS revenue, max(available_at) AS available_at, count(*) AS versions FROM filings WHERE available_at <= DATE '{CUTOFF}' AND period_end <= DATE '{CUTOFF}' GROUP BY 1, 2)"""

ORACLE_SQL = {
    "price_scan_dedup": """
SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS ticker, l_shipdate::DATE AS price_date, count(*) AS points, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS close, count(*) > 1 AS duplicate FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
    "market_first_timestamp": _SIGNALS + "\nSELECT d.signal_date, (SELECT min(price_date) FROM prices WHERE price_date >= d.signal_date) AS market_date FROM (SELECT DISTINCT signal_date FROM signals) d",
    "price_mark_timestamps": with_views("securities", "prices", "dates", "signals") + """,
h AS (SELECT market, signal_date, ticker FROM signals JOIN securities USING (ticker) QUALIFY row_number() OVER (PARTITION BY market, signal_date ORDER BY signal DESC, ticker) <= 3),
d AS (SELECT market, signal_date, price_date, count(DISTINCT ticker) AS names FROM h JOIN (SELECT ticker, price_date, (date_trunc('quarter', price_date) - INTERVAL 1 DAY)::DATE AS signal_date FROM prices) USING (ticker, signal_date) GROUP BY 1, 2, 3)
SELECT market, signal_date, count(*) AS marks, count(*) FILTER (WHERE names = 3) AS common, min(price_date) FILTER (WHERE names = 3) AS first_common FROM d GROUP BY 1, 2""",
    "next_usable_signal": with_views("filings", "dates") + """
SELECT issuer, version, available_at, (SELECT min(signal_date) FROM dates WHERE signal_date > available_at) AS usable_at FROM filings""",
    "pit_history": _HISTORY + "\nSELECT *, row_number() OVER (PARTITION BY issuer ORDER BY period_end)::INTEGER AS position FROM hs",
    "pit_comparables": _HISTORY + """,
l AS (SELECT issuer, max(period_end) AS period_end, arg_max(revenue, period_end) AS revenue FROM hs GROUP BY 1)
SELECT l.issuer, l.period_end, l.revenue, h.revenue AS prior_revenue, round(l.revenue / h.revenue - 1, 6) AS growth FROM l LEFT JOIN hs h ON h.issuer = l.issuer AND h.period_end = last_day((l.period_end - INTERVAL 12 MONTH)::DATE)""",
    "quarter_pairs": with_views("filings") + """,
o AS (SELECT issuer, period_end, arg_min(revenue, (available_at, version)) AS revenue FROM filings GROUP BY 1, 2)
SELECT a.issuer, b.period_end AS prior_end, a.period_end, round(a.revenue / b.revenue - 1, 6) AS growth FROM o a JOIN o b ON a.issuer = b.issuer AND a.period_end = last_day((b.period_end + INTERVAL 3 MONTH)::DATE)""",
    "revenue_continuity": _HISTORY + """,
r AS (SELECT issuer, period_end, round(revenue / lag(revenue) OVER (PARTITION BY issuer ORDER BY period_end), 6) AS ratio FROM hs WHERE revenue > 0)
SELECT issuer, ratio, coalesce(ratio BETWEEN 0.1 AND 10, true) AS continuous FROM r QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY period_end DESC) = 1""",
    "universe_eligible": with_views("securities", "prices", "dates") + """,
f AS (SELECT ticker, min(price_date) AS listed FROM prices GROUP BY 1),
t AS (SELECT signal_date, ticker, round(sum(amount), 2) AS traded, arg_max(close, price_date) AS close FROM prices JOIN dates ON signal_date - price_date >= 0 AND signal_date - price_date < 60 GROUP BY 1, 2),
s AS (SELECT *, round((rank() OVER (PARTITION BY signal_date ORDER BY traded) + (count(*) OVER (PARTITION BY signal_date, traded) - 1) / 2) / count(*) OVER (PARTITION BY signal_date), 9) AS share FROM t),
k AS (SELECT signal_date, ticker, share, round(close * shares, 4) AS size FROM s JOIN f USING (ticker) JOIN securities USING (ticker) WHERE signal_date - listed >= 365 AND share >= 0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY size, ticker) AS r, count(*) OVER (PARTITION BY signal_date) AS n FROM k)
SELECT signal_date, ticker, round(share, 6) AS share, CASE WHEN n > 1 THEN least(3, (r - 1) * 3 // (n - 1) + 1) ELSE 1 END::INTEGER AS bucket FROM r""",
    "facts_preferred": """
SELECT o_custkey AS issuer, date_trunc('year', o_orderdate)::DATE AS period, arg_max(o_totalprice, (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END, o_orderpriority = '5-LOW', o_orderdate::DATE, o_orderkey)) AS value,
  count(*) AS candidates, count(DISTINCT o_totalprice) > 1 AS conflict FROM orders GROUP BY 1, 2""",
    "debt_fallback": """
WITH s AS (SELECT o_custkey AS issuer, year(o_orderdate)::INTEGER AS year, sum(o_totalprice::DECIMAL(14,2)) FILTER (WHERE o_orderpriority = '1-URGENT') AS total, sum(o_totalprice::DECIMAL(14,2)) FILTER (WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) AS parts,
  count(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) AS units FROM orders GROUP BY 1, 2)
SELECT issuer, year, coalesce(total, CASE WHEN units = 1 THEN parts END)::DOUBLE AS debt, CASE WHEN total IS NOT NULL THEN 'REPORTED' WHEN units = 1 THEN 'DERIVED' WHEN units > 1 THEN 'INCOMPATIBLE_UNITS' ELSE 'MISSING' END AS source FROM s""",
    "distinct_abs_sum": """
WITH v AS (SELECT l_orderkey, (CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END)::DECIMAL(14,2) AS v FROM lineitem)
SELECT l_orderkey, sum(DISTINCT abs(v))::DOUBLE AS total, arg_max(v, (abs(v), v))::DOUBLE AS largest FROM v GROUP BY 1""",
    "ledger_active_asof": f"""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events WHERE ts <= TIMESTAMP '{LEDGER_AT}' AND event_type <> 'error' GROUP BY 1, 2""",
    "ledger_merge": f"""
SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN count(*) FILTER (WHERE ts <= TIMESTAMP '{LEDGER_AT}') = 0 THEN 'NEW' WHEN count(*) FILTER (WHERE ts > TIMESTAMP '{LEDGER_AT}') > 0 THEN 'SEEN_AGAIN' ELSE 'CARRIED' END AS status FROM events GROUP BY 1, 2""",
    "dataset_seal_hash": """
WITH r AS (SELECT 'nation' AS dataset, sha256(n_nationkey || chr(9) || n_name) AS h FROM nation UNION ALL SELECT 'supplier', sha256(s_suppkey || chr(9) || s_name) FROM supplier UNION ALL SELECT 'customer', sha256(c_custkey || chr(9) || c_name) FROM customer),
b AS (SELECT dataset, substr(h, 1, 2) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1, 2)
SELECT dataset, sum(n)::BIGINT AS rows, sha256(string_agg(d, chr(10) ORDER BY d)) AS seal FROM b GROUP BY 1""",
    "set_equality_check": _SIGNALS + """,
n AS (SELECT signal_date, ticker FROM signals), w AS (SELECT last_day((signal_date + INTERVAL 3 MONTH)::DATE) AS signal_date, ticker FROM signals),
s AS (SELECT coalesce(n.signal_date, w.signal_date) AS signal_date, count(*) FILTER (WHERE n.ticker IS NOT NULL AND w.ticker IS NOT NULL) AS stayed, count(*) FILTER (WHERE w.ticker IS NULL) AS came, count(*) FILTER (WHERE n.ticker IS NULL) AS went
  FROM n FULL JOIN w ON n.signal_date = w.signal_date AND n.ticker = w.ticker GROUP BY 1)
SELECT *, came = 0 AND went = 0 AS equal, round(stayed / (stayed + came + went), 8) AS jaccard FROM s""",
    "ticker_set_seal": _SIGNALS + "\nSELECT signal_date, count(*) AS names, sha256(string_agg(DISTINCT ticker, chr(10) ORDER BY ticker)) AS seal FROM signals GROUP BY 1",
}
