"""Queries over filings, facts, valuations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import latest_version
from tidemark.plans.views import facts, filings, with_views
from tidemark.sources.tables import table

CUTOFF = "2000-06-30"
MEASURES = ("REVENUE", "EBIT", "CAPEX", "CASH")


def latest_filings(spark, sf_dir: str) -> DataFrame:
    """For each issuer and period the version last available at the cutoff."""
    return latest_version(filings(spark, sf_dir), ["issuer", "period_end"], "available_at", "version", F.to_date(F.lit(CUTOFF)))


def filing_pairs(spark, sf_dir: str) -> DataFrame:
    """Each issuer's consecutive periods, by first version, with the change of revenue."""
    first = Window.partitionBy("issuer", "period_end").orderBy("available_at", "version")
    one = filings(spark, sf_dir).withColumn("r", F.row_number().over(first)).filter("r = 1")
    order = Window.partitionBy("issuer").orderBy("period_end")
    pairs = one.withColumns({"prior_end": F.lag("period_end").over(order), "prior_revenue": F.lag("revenue").over(order)})
    return pairs.filter("prior_end is not null").select("issuer", "prior_end", "period_end", F.round(F.col("revenue") / F.col("prior_revenue") - 1, 6).alias("growth"))


def amendments(spark, sf_dir: str) -> DataFrame:
    """Periods with several versions: how many, and the last revenue less the first."""
    order = F.struct("available_at", "version")
    grouped = filings(spark, sf_dir).groupBy("issuer", "period_end").agg(
        F.count("*").alias("n"), F.round(F.max_by("revenue", order) - F.min_by("revenue", order), 2).alias("effect")
    )
    return grouped.filter("n > 1")


def fundamentals(spark, sf_dir: str) -> DataFrame:
    """A column per measure; null where an issuer reports none in the year."""
    wide = facts(spark, sf_dir).groupBy("issuer", "fiscal_year").pivot("account", list(MEASURES)).agg(F.sum("amount").cast("double"))
    return wide.withColumnsRenamed({m: m.lower() for m in MEASURES})


def max_account(spark, sf_dir: str) -> DataFrame:
    """The account with the largest absolute amount of each issuer and year; ties to the first name."""
    sums = facts(spark, sf_dir).groupBy("issuer", "fiscal_year", "account").agg(F.sum("amount").cast("double").alias("amount"))
    order = Window.partitionBy("issuer", "fiscal_year").orderBy(F.desc(F.abs("amount")), "account")
    return sums.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


TAX, WACC, GROWTH, YEARS = 0.24, 0.105, 0.02, 5
#: Shares of revenue for depreciation, capital expenditure and working capital.
DEPRECIATION, CAPEX, WORKING_CAPITAL = 0.03, 0.04, 0.10
TERMINAL_MAX = 0.85


def dcf(spark, sf_dir: str) -> DataFrame:
    """Enterprise value by discounted free cash flow over ``YEARS`` years and a terminal value, with a status.

    The recurrence runs inside one expression: no rows are made for years.
    """
    base = fundamentals(spark, sf_dir).filter("revenue > 0").withColumns(
        {"margin": F.when(F.col("ebit").isNotNull(), F.greatest(F.lit(-0.2), F.least(F.lit(0.35), F.col("ebit") / F.col("revenue") / 4))), "debt": -F.coalesce("cash", F.lit(0.0))}
    )
    nothing = F.when(F.col("margin").isNotNull(), F.lit(0.0))  # null without a margin, and so is all that follows
    start = F.struct(F.col("revenue").alias("rev"), nothing.alias("pv"), nothing.alias("fcf"))

    def year(acc, t):
        rev = acc["rev"] * (1 + GROWTH)
        fcf = rev * F.col("margin") * (1 - TAX) + rev * DEPRECIATION - rev * CAPEX - (rev - acc["rev"]) * WORKING_CAPITAL
        return F.struct(rev.alias("rev"), (acc["pv"] + fcf / F.pow(F.lit(1 + WACC), t)).alias("pv"), fcf.alias("fcf"))

    flows = base.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(YEARS)), start, year))
    valued = flows.withColumn("tv", F.col("f.fcf") * (1 + GROWTH) / (WACC - GROWTH) / F.pow(F.lit(1 + WACC), F.lit(YEARS))).withColumn("ev", F.col("f.pv") + F.col("tv"))
    status = (
        F.when(F.col("margin").isNull(), "MISSING_EBIT").when(F.col("ev") <= 0, "EV_NOT_POSITIVE").when(F.col("f.fcf") <= 0, "LAST_FCF_NOT_POSITIVE")
        .when(F.col("tv") / F.col("ev") > TERMINAL_MAX, "TERMINAL_SHARE").otherwise("OK")
    )
    return valued.select("issuer", "fiscal_year", F.round("ev", 2).alias("ev"), F.round(F.col("ev") - F.col("debt"), 2).alias("equity"), status.alias("status"))


def majority(spark, sf_dir: str) -> DataFrame:
    """Each conversation's most frequent role, if over half of the votes."""
    votes = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv_id"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("n"), "role")
    top = votes.withColumns({"r": F.row_number().over(order), "votes": total}).filter("r = 1")
    return top.select("conv_id", "votes", F.when(2 * F.col("n") > F.col("votes"), F.col("role")).alias("majority"))


def ledger(spark, sf_dir: str) -> DataFrame:
    """Validity intervals of each user's event types: a row per change of type."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(order)).filter("before is null or before <> event_type")
    return changed.select("user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_to"))


def tumbling(spark, sf_dir: str) -> DataFrame:
    """Events and their values by hour and type."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def exact_copies(spark, sf_dir: str) -> DataFrame:
    """Each text's digest once, with its first document and number of copies."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\t\n\r]+", " "))
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


QUERIES = {
    "pit_latest_filing_version": latest_filings,
    "filing_pairs_consecutive": filing_pairs,
    "amendment_effect": amendments,
    "pivot_fundamentals": fundamentals,
    "max_abs_account": max_account,
    "dcf_fcff": dcf,
    "majority_consensus": majority,
    "ledger_scd2": ledger,
    "events_tumbling": tumbling,
    "exact_dedup": exact_copies,
}

WIDE_SQL = with_views("facts") + """,
wide AS (SELECT issuer, fiscal_year, (sum(amount) FILTER (WHERE account = 'REVENUE'))::DOUBLE AS revenue, (sum(amount) FILTER (WHERE account = 'EBIT'))::DOUBLE AS ebit,
  (sum(amount) FILTER (WHERE account = 'CAPEX'))::DOUBLE AS capex, (sum(amount) FILTER (WHERE account = 'CASH'))::DOUBLE AS cash FROM facts GROUP BY 1, 2)"""

ORACLE_SQL = {
    "pit_latest_filing_version": with_views("filings") + """
SELECT issuer, period_end, available_at, version, revenue FROM filings WHERE available_at <= DATE '2000-06-30'
QUALIFY row_number() OVER (PARTITION BY issuer, period_end ORDER BY available_at DESC, version DESC) = 1""",
    "filing_pairs_consecutive": with_views("filings") + """,
one AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY issuer, period_end ORDER BY available_at, version) = 1),
p AS (SELECT *, lag(period_end) OVER w AS prior_end, lag(revenue) OVER w AS prior_revenue FROM one WINDOW w AS (PARTITION BY issuer ORDER BY period_end))
SELECT issuer, prior_end, period_end, round(revenue / prior_revenue - 1, 6) AS growth FROM p WHERE prior_end IS NOT NULL""",
    "amendment_effect": with_views("filings") + """
SELECT issuer, period_end, count(*) AS n, round(arg_max(revenue, (available_at, version)) - arg_min(revenue, (available_at, version)), 2) AS effect
FROM filings GROUP BY 1, 2 HAVING count(*) > 1""",
    "pivot_fundamentals": WIDE_SQL + "\nSELECT * FROM wide",
    "max_abs_account": with_views("facts") + """,
s AS (SELECT issuer, fiscal_year, account, sum(amount)::DOUBLE AS amount FROM facts GROUP BY 1, 2, 3)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY issuer, fiscal_year ORDER BY abs(amount) DESC, account) = 1""",
    "dcf_fcff": WIDE_SQL + """,
b AS (SELECT issuer, fiscal_year, revenue, CASE WHEN ebit IS NOT NULL THEN greatest(-0.2, least(0.35, ebit / revenue / 4)) END::DOUBLE AS margin, coalesce(cash, 0) AS cash FROM wide WHERE revenue > 0),
y AS (SELECT *, t, revenue * pow(1.02, t) * (margin * 0.76 + 0.03 - 0.04) - (revenue * pow(1.02, t) - revenue * pow(1.02, t - 1)) * 0.10 AS fcf FROM b, range(1, 6) AS g(t)),
v AS (SELECT issuer, fiscal_year, any_value(margin) AS margin, any_value(cash) AS cash, sum(fcf / pow(1.105, t)) AS pv, max(fcf) FILTER (WHERE t = 5) AS last FROM y GROUP BY 1, 2),
e AS (SELECT *, last * 1.02 / 0.085 / pow(1.105, 5) AS tv FROM v)
SELECT issuer, fiscal_year, round(pv + tv, 2) AS ev, round(pv + tv + cash, 2) AS equity,
  CASE WHEN margin IS NULL THEN 'MISSING_EBIT' WHEN pv + tv <= 0 THEN 'EV_NOT_POSITIVE' WHEN last <= 0 THEN 'LAST_FCF_NOT_POSITIVE' WHEN tv / (pv + tv) > 0.85 THEN 'TERMINAL_SHARE' ELSE 'OK' END AS status FROM e""",
    "majority_consensus": """
WITH v AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2),
r AS (SELECT *, (sum(n) OVER (PARTITION BY conv_id))::BIGINT AS votes, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM v)
SELECT conv_id, votes, CASE WHEN 2 * n > votes THEN role END AS majority FROM r WHERE r = 1""",
    "ledger_scd2": """
WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
c AS (SELECT * FROM b WHERE before IS NULL OR before <> event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM c""",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "exact_dedup": r"""
SELECT sha256(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\t\n\r]+', ' ', 'g'), ' ')) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1""",
}
