"""Gates: what may be used at a cutoff, and whether coverage and stability suffice. A gate gives reasons, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans import evidence, market
from tidemark.plans.companies import CUTOFF
from tidemark.plans.views import with_views
from tidemark.sources.tables import table

#: Oldest price of a signal in days, and the largest change of a score under anonymisation.
SIGNAL_PRICE_DAYS, SCORE_DELTA = 7, 0.5
#: Axes on which erosion is severe.
SEVERE = ("PRICING_POWER", "SWITCHING_COST", "OTHER_MOAT", "FRAGILITY")
AXES = (*SEVERE, "DEMAND", "COST")
SOURCES = ("FILING", "IR", "INDUSTRY")
#: Least rows and issuers of a band, and the largest share of one issuer.
BAND_ROWS, BAND_ISSUERS, TOP_SHARE = 20, 10, 0.25
#: Least confidence and most warnings of a trusted value.
TRUST_CONFIDENCE, TRUST_WARNINGS = 0.5, 3
#: Methods by type of company.
TYPES = {
    "FINANCIAL": "EXCESS_RETURN_EQUITY", "PRE_REVENUE_BIOTECH": "BIOTECH_RNPV", "DISTRESSED": "FAILURE_ADJUSTED_DCF", "HIGH_GROWTH_PLATFORM": "NARRATIVE_DCF", "MATURE_NON_FINANCIAL": "STEADY_STATE_FCFF", "GENERAL": "ECONOMIC_FCFF",
}


def _first(*reasons: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, or ``OK``."""
    out = F.lit("OK")
    for wrong, name in reversed(reasons):
        out = F.when(wrong, name).otherwise(out)
    return out


def citations(spark, sf_dir: str) -> DataFrame:
    """Citations of twenty characters, some not entailed, of absent or later documents, beyond the end or not exact."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("date_add(date'2000-01-01', cast(doc_id % 365 as int))").alias("available_at"))
    start = (F.col("doc_id") % 40).cast("int")
    source = F.when(F.col("doc_id") % 23 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    quote = F.when(F.col("doc_id") % 11 == 0, "something else here!").otherwise(F.substr("text", start + 1, F.lit(20)))
    made = docs.select(F.col("doc_id").alias("judgment"), source.alias("source"), start.alias("start"), quote.alias("quote"), (F.col("doc_id") % 13 != 0).alias("entailed"))
    met = made.join(docs, F.col("source") == F.col("doc_id"), "left")
    return met.select("judgment", _first(
        (~F.col("entailed"), "NOT_ENTAILED"), (F.col("doc_id").isNull(), "SOURCE_ABSENT"), (F.col("available_at") > F.lit(CUTOFF).cast("date"), "FUTURE_EVIDENCE"),
        (F.col("start") + 20 > F.length("text"), "SPAN_TOO_LONG"), (F.substr("text", F.col("start") + 1, F.lit(20)) != F.col("quote"), "NOT_EXACT"),
    ).alias("verdict"))


def signal_prices(spark, sf_dir: str) -> DataFrame:
    """Signals whose price is missing, later than the signal, or too old, by date."""
    entry = market.entry_prices(spark, sf_dir)
    age = F.datediff("signal_date", "price_date")
    verdict = _first((F.col("price_date").isNull(), "NO_PRICE"), (age < 0, "FUTURE_PRICE"), (age > SIGNAL_PRICE_DAYS, "STALE_PRICE"))
    return entry.withColumn("verdict", verdict).groupBy("signal_date", "verdict").agg(F.count("*").alias("n"))


def stability(spark, sf_dir: str) -> DataFrame:
    """Pairs that anonymising changes: another class, a score that comes or goes, or one that moves too far, by segment."""
    key = F.col("c_custkey")
    a, b = F.when(key % 17 != 0, (key % 10) / 2), F.when(key % 19 != 0, (key % 10) / 2 + F.when(key % 7 == 0, 0.75).otherwise(0.25))
    verdict = _first((key % 29 == 0, "OTHER_CLASS"), (a.isNull() != b.isNull(), "SCORE_APPEARS"), (F.abs(a - b) > SCORE_DELTA, "SCORE_MOVES"))
    rows = table(spark, sf_dir, "customer").withColumn("verdict", verdict)
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("pairs"), *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("OTHER_CLASS", "SCORE_APPEARS", "SCORE_MOVES")), F.bool_and(F.col("verdict") == "OK").alias("passed"))


def traps(spark, sf_dir: str) -> DataFrame:
    """Whether every question about the future was answered as unknown, by conversation: no assistant turn may name a year."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    told = F.coalesce(F.col("text").rlike("(19|20)[0-9]{2}"), F.lit(False))
    return rows.groupBy("conv_id").agg(F.count("*").alias("answers"), F.count_if(told).alias("failed"), F.bool_and(~told).alias("passed"))


def overlay(spark, sf_dir: str) -> DataFrame:
    """Veto with two severe erosive claims of two sources, a cap with any erosive claim, else pass."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack"), pick(AXES, F.col("o_orderkey")).alias("axis"), pick(SOURCES, F.floor(F.col("o_orderkey") / 7)).alias("source"), (F.col("o_orderkey") % 9 == 0).alias("erosive"))
    severe = F.col("erosive") & F.col("axis").isin(*SEVERE)
    sums = rows.groupBy("pack").agg(F.count("*").alias("claims"), F.count_if("erosive").alias("erosive"), F.count_if(severe).alias("severe"), F.count_distinct(F.when(severe, F.col("source"))).alias("sources"))
    return sums.withColumn("action", F.when((F.col("severe") >= 2) & (F.col("sources") >= 2), "VETO").when(F.col("erosive") > 0, "POSITION_CAP").otherwise("PASS"))


def band_coverage(spark, sf_dir: str) -> DataFrame:
    """Bands of the net direction against least rows and issuers and the share of one issuer."""
    rows = evidence.signed_breadth(spark, sf_dir).withColumn("band", F.signum("net").cast("long"))
    each = rows.groupBy("band", "issuer").agg(F.count("*").alias("c"), F.count_distinct("fiscal_year").alias("y"))
    bands = each.groupBy("band").agg(F.sum("c").alias("rows"), F.count("*").alias("issuers"), F.round(F.max("c") / F.sum("c"), 8).alias("top_share"))
    return bands.withColumn("passed", (F.col("rows") >= BAND_ROWS) & (F.col("issuers") >= BAND_ISSUERS) & (F.col("top_share") <= TOP_SHARE))


def trusted(spark, sf_dir: str) -> DataFrame:
    """Status of a value by route, sign, screening, confidence and warnings, with the reasons; and what a three-way check leaves open."""
    key = F.col("c_custkey")
    value, confidence, warnings = F.col("c_acctbal"), F.when(key % 8 != 0, (key % 10) / 10), key % 6
    eligible, screened = key % 5 != 0, key % 7 != 0
    reasons = F.array_compact(F.array(
        F.when(value <= 0, "NON_POSITIVE_FAIR_VALUE"), F.when(~screened, "SCREENING_INELIGIBLE"), F.when(F.coalesce(confidence < TRUST_CONFIDENCE, F.lit(True)), "LOW_OR_MISSING_ASSUMPTION_CONFIDENCE"), F.when(warnings > TRUST_WARNINGS, "TOO_MANY_VALUATION_WARNINGS"),
    ))
    status = F.when(~eligible, "MODEL_NOT_APPLICABLE").when(value <= 0, "INVALID_VALUATION").when(F.size(reasons) > 0, "UNTRUSTED_VALUATION").otherwise("VALID")
    review = (key % 4).isin(2, 3) | (key % 6).isin(1, 2, 3)
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), F.array_join(reasons, ",").alias("reasons"), (key % 3 != 0).alias("hard_gate"), review.alias("review"))


def model_routes(spark, sf_dir: str) -> DataFrame:
    """The engine for a type of company, and whether there is one."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("s_suppkey") % len(TYPES) + 1).cast("int"))
    method = F.lit(TYPES["GENERAL"])
    for name, engine in TYPES.items():
        method = F.when(kind == name, engine).otherwise(method)
    return table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("type"), method.alias("method"), (kind != "FINANCIAL").alias("implemented"))


QUERIES = {
    "cutoff_evidence_gate": citations,
    "signal_pit_gate": signal_prices,
    "anonymization_stability": stability,
    "future_knowledge_traps": traps,
    "overlay_decision": overlay,
    "band_coverage_gate": band_coverage,
    "trust_gate": trusted,
    "model_routes": model_routes,
}

_AXES_SQL = evidence.ORACLE_SQL["signed_breadth"].rsplit("\nSELECT", 1)[0]


ORACLE_SQL = {
    "cutoff_evidence_gate": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, DATE '2000-01-01' + (doc_id % 365)::INTEGER AS available_at FROM documents),
m AS (SELECT doc_id AS judgment, CASE WHEN doc_id % 23 = 0 THEN -doc_id - 1 ELSE doc_id END AS source, (doc_id % 40)::INTEGER AS start, CASE WHEN doc_id % 11 = 0 THEN 'something else here!' ELSE substr(text, (doc_id % 40)::INTEGER + 1, 20) END AS quote, doc_id % 13 <> 0 AS entailed FROM d)
SELECT judgment, CASE WHEN NOT entailed THEN 'NOT_ENTAILED' WHEN doc_id IS NULL THEN 'SOURCE_ABSENT' WHEN available_at > DATE '{CUTOFF}' THEN 'FUTURE_EVIDENCE' WHEN start + 20 > length(text) THEN 'SPAN_TOO_LONG' WHEN substr(text, start + 1, 20) <> quote THEN 'NOT_EXACT' ELSE 'OK' END AS verdict
FROM m LEFT JOIN d ON source = doc_id""",
    "signal_pit_gate": with_views("prices", "dates", "signals") + """,
e AS (SELECT s.signal_date, CASE WHEN s.signal_date - p.price_date <= 10 THEN p.price_date END AS p FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.signal_date >= p.price_date)
SELECT signal_date, CASE WHEN p IS NULL THEN 'NO_PRICE' WHEN signal_date - p > 7 THEN 'STALE_PRICE' ELSE 'OK' END AS verdict, count(*) AS n FROM e GROUP BY 1, 2""",
    "anonymization_stability": """
WITH s AS (SELECT c_mktsegment, c_custkey AS k, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 10) / 2 END AS a, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey % 10) / 2 + CASE WHEN c_custkey % 7 = 0 THEN 0.75 ELSE 0.25 END END AS b FROM customer),
v AS (SELECT c_mktsegment, CASE WHEN k % 29 = 0 THEN 'OTHER_CLASS' WHEN (a IS NULL) <> (b IS NULL) THEN 'SCORE_APPEARS' WHEN abs(a - b) > 0.5 THEN 'SCORE_MOVES' ELSE 'OK' END AS v FROM s)
SELECT c_mktsegment, count(*) AS pairs, count(*) FILTER (WHERE v = 'OTHER_CLASS') AS other_class, count(*) FILTER (WHERE v = 'SCORE_APPEARS') AS score_appears, count(*) FILTER (WHERE v = 'SCORE_MOVES') AS score_moves, bool_and(v = 'OK') AS passed FROM v GROUP BY 1""",
    "future_knowledge_traps": """
WITH t AS (SELECT conv_id, coalesce(regexp_matches(text, '(19|20)[0-9]{2}'), false) AS told FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(*) AS answers, count(*) FILTER (WHERE told) AS failed, bool_and(NOT told) AS passed FROM t GROUP BY 1""",
    "overlay_decision": """
WITH c AS (SELECT o_custkey AS pack, ['PRICING_POWER', 'SWITCHING_COST', 'OTHER_MOAT', 'FRAGILITY', 'DEMAND', 'COST'][o_orderkey % 6 + 1] AS axis, o_orderkey // 7 % 3 AS source, o_orderkey % 9 = 0 AS erosive FROM orders),
s AS (SELECT pack, count(*) AS claims, count(*) FILTER (WHERE erosive) AS erosive, count(*) FILTER (WHERE erosive AND axis NOT IN ('DEMAND', 'COST')) AS severe, count(DISTINCT source) FILTER (WHERE erosive AND axis NOT IN ('DEMAND', 'COST')) AS sources FROM c GROUP BY 1)
SELECT *, CASE WHEN severe >= 2 AND sources >= 2 THEN 'VETO' WHEN erosive > 0 THEN 'POSITION_CAP' ELSE 'PASS' END AS action FROM s""",
    "band_coverage_gate": _AXES_SQL + """,
e AS (SELECT sign(net)::BIGINT AS band, issuer, count(*) AS c FROM br GROUP BY 1, 2),
s AS (SELECT band, sum(c)::BIGINT AS rows, count(*) AS issuers, round(max(c) / sum(c), 8) AS top_share FROM e GROUP BY 1)
SELECT *, rows >= 20 AND issuers >= 10 AND top_share <= 0.25 AS passed FROM s""",
    "trust_gate": """
WITH k AS (SELECT c_custkey AS k, c_acctbal AS v, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 10) / 10 END AS c FROM customer),
r AS (SELECT *, concat_ws(',', CASE WHEN v <= 0 THEN 'NON_POSITIVE_FAIR_VALUE' END, CASE WHEN k % 7 = 0 THEN 'SCREENING_INELIGIBLE' END, CASE WHEN coalesce(c < 0.5, true) THEN 'LOW_OR_MISSING_ASSUMPTION_CONFIDENCE' END, CASE WHEN k % 6 > 3 THEN 'TOO_MANY_VALUATION_WARNINGS' END) AS reasons FROM k)
SELECT k AS c_custkey, CASE WHEN k % 5 = 0 THEN 'MODEL_NOT_APPLICABLE' WHEN v <= 0 THEN 'INVALID_VALUATION' WHEN reasons <> '' THEN 'UNTRUSTED_VALUATION' ELSE 'VALID' END AS status, reasons, k % 3 <> 0 AS hard_gate, k % 4 IN (2, 3) OR k % 6 IN (1, 2, 3) AS review FROM r""",
    "model_routes": """
WITH t AS (SELECT s_suppkey, ['FINANCIAL', 'PRE_REVENUE_BIOTECH', 'DISTRESSED', 'HIGH_GROWTH_PLATFORM', 'MATURE_NON_FINANCIAL', 'GENERAL'][s_suppkey % 6 + 1] AS type FROM supplier)
SELECT s_suppkey, type, CASE type WHEN 'FINANCIAL' THEN 'EXCESS_RETURN_EQUITY' WHEN 'PRE_REVENUE_BIOTECH' THEN 'BIOTECH_RNPV' WHEN 'DISTRESSED' THEN 'FAILURE_ADJUSTED_DCF' WHEN 'HIGH_GROWTH_PLATFORM' THEN 'NARRATIVE_DCF' WHEN 'MATURE_NON_FINANCIAL' THEN 'STEADY_STATE_FCFF' ELSE 'ECONOMIC_FCFF' END AS method,
  type <> 'FINANCIAL' AS implemented FROM t""",
}
