"""Business reports in XML made of the facts of filings, read back as facts and metrics of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.views import facts, with_views
from tidemark.sources import xbrl

#: Concept, context and the column of each element; the best context of a metric is not always the first.
ELEMENTS = (
    ("ifrs-full:Revenue", "Q", "quarter"), ("ifrs-full:Revenue", "S", "half"), ("ifrs-full:Revenue", "C", "revenue"), ("ifrs-full:ProfitLossFromOperatingActivities", "N", "ebit"),
    ("ifrs-full:PurchaseOfPropertyPlantAndEquipment", "C", "capex"), ("ifrs-full:PurchaseOfIntangibleAssets", "C", "capex"), ("ifrs-full:PurchaseOfIntangibleAssets", "C", "ten"),
    ("ifrs-full:CashAndCashEquivalents", "PN", "twice"), ("ifrs-full:CashAndCashEquivalents", "P", "cash"), ("ifrs-full:ShortTermBorrowings", "P", "other"), ("ifrs-full:LeaseLiabilities", "P", "other"),
    ("ifrs-full:Inventories", "P", "other"), ("ifrs-full:TradePayables", "P", "cash"),
)


def instances(spark, sf_dir: str) -> DataFrame:
    """``(issuer, fiscal_year, report, xml)``: a report of each issuer and year, with consolidated, separate and quarterly contexts."""
    amount = lambda a: F.sum(F.when(F.col("account") == a, F.col("amount"))).cast("decimal(24,2)")
    sums = facts(spark, sf_dir).groupBy("issuer", "fiscal_year").agg(*(amount(a).alias(n) for a, n in (("REVENUE", "revenue"), ("EBIT", "ebit"), ("CAPEX", "capex"), ("CASH", "cash"), ("OTHER", "other"))))
    known = sums.withColumns({"quarter": F.col("revenue") * 3, "half": F.col("revenue") * 2, "twice": F.col("cash") * 2, "ten": F.lit(10).cast("decimal(24,2)")})
    year = F.col("fiscal_year").cast("string")
    span = lambda start: F.concat(F.lit("<xbrli:period><xbrli:startDate>"), year, F.lit(f"-{start}</xbrli:startDate><xbrli:endDate>"), year, F.lit("-12-31</xbrli:endDate></xbrli:period>"))
    point = F.concat(F.lit("<xbrli:period><xbrli:instant>"), year, F.lit("-12-31</xbrli:instant></xbrli:period>"))

    def context(name: str, period: Column, *members: str) -> Column:
        told = "".join(f'<xbrldi:explicitMember dimension="ifrs-full:Axis">ifrs-full:{m}</xbrldi:explicitMember>' for m in members)
        return F.concat(F.lit(f'<xbrli:context id="{name}"><xbrli:entity><xbrli:identifier scheme="http://scheme">'), F.col("issuer").cast("string"), F.lit(f"</xbrli:identifier><xbrli:segment>{told}</xbrli:segment></xbrli:entity>"), period, F.lit("</xbrli:context>"))

    told = [context("C", span("01-01"), "ConsolidatedMember"), context("S", span("01-01"), "SeparateMember"), context("N", span("01-01")), context("Q", span("10-01"), "ConsolidatedMember"), context("P", point, "ConsolidatedMember"), context("PN", point)]
    written = [F.concat(F.lit(f'<{concept} contextRef="{c}" unitRef="KRW" decimals="2">'), F.format_number(column, 2), F.lit(f"</{concept}>")) for concept, c, column in ELEMENTS]
    xml = F.concat(F.lit('<?xml version="1.0"?><xbrli:xbrl>'), *told, *(F.coalesce(w, F.lit("")) for w in written), F.lit("</xbrli:xbrl>"))
    return known.select("issuer", "fiscal_year", F.format_string("%d-%d", "issuer", "fiscal_year").alias("report"), xml.alias("xml"))


def report_facts(spark, sf_dir: str) -> DataFrame:
    """How many facts of each concept the reports of a year hold in which context, and their sum."""
    found = xbrl.facts(instances(spark, sf_dir), "report", "xml")
    return found.groupBy(F.year(F.coalesce("end", "instant")).alias("fiscal_year"), "concept", "context_id").agg(F.count("value").alias("facts"), F.round(F.sum("value").cast("double"), 2).alias("total"))


def report_metrics(spark, sf_dir: str) -> DataFrame:
    """Metrics of each report's year, from each metric's best context."""
    found = xbrl.facts(instances(spark, sf_dir), "report", "xml").withColumn("period_end", F.make_date(F.split("report", "-")[1].cast("int"), F.lit(12), F.lit(31)))
    out = xbrl.annual_metrics(found, "report", F.col("period_end"))
    return out.select("report", "facts", *(F.col(c).cast("double").alias(c) for c in ("revenue", "ebit", "capex", "cash", "debt", "nwc")), F.col("covered").cast("long").alias("covered"))


QUERIES = {"xbrl_facts": report_facts, "xbrl_annual_metrics": report_metrics}

_SUMS = with_views("facts") + """,
s AS (SELECT issuer, fiscal_year, sum(amount) FILTER (WHERE account = 'REVENUE') AS revenue, sum(amount) FILTER (WHERE account = 'EBIT') AS ebit, sum(amount) FILTER (WHERE account = 'CAPEX') AS capex,
  sum(amount) FILTER (WHERE account = 'CASH') AS cash, sum(amount) FILTER (WHERE account = 'OTHER') AS other FROM facts GROUP BY 1, 2)"""

ORACLE_SQL = {
    "xbrl_facts": _SUMS + """,
l AS (SELECT fiscal_year, u.concept, u.context_id, u.v FROM s, LATERAL (SELECT unnest([
  {'concept': 'Revenue', 'context_id': 'Q', 'v': 3 * revenue}, {'concept': 'Revenue', 'context_id': 'S', 'v': 2 * revenue}, {'concept': 'Revenue', 'context_id': 'C', 'v': revenue},
  {'concept': 'ProfitLossFromOperatingActivities', 'context_id': 'N', 'v': ebit}, {'concept': 'PurchaseOfPropertyPlantAndEquipment', 'context_id': 'C', 'v': capex},
  {'concept': 'PurchaseOfIntangibleAssets', 'context_id': 'C', 'v': capex}, {'concept': 'PurchaseOfIntangibleAssets', 'context_id': 'C', 'v': 10},
  {'concept': 'CashAndCashEquivalents', 'context_id': 'PN', 'v': 2 * cash}, {'concept': 'CashAndCashEquivalents', 'context_id': 'P', 'v': cash}, {'concept': 'ShortTermBorrowings', 'context_id': 'P', 'v': other},
  {'concept': 'LeaseLiabilities', 'context_id': 'P', 'v': other}, {'concept': 'Inventories', 'context_id': 'P', 'v': other}, {'concept': 'TradePayables', 'context_id': 'P', 'v': cash}]) AS u))
SELECT fiscal_year, concept, context_id, count(*) AS facts, round(sum(v)::DOUBLE, 2) AS total FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
    "xbrl_annual_metrics": _SUMS + """
SELECT issuer || '-' || fiscal_year AS report, 1 + 3 * (revenue IS NOT NULL)::BIGINT + (ebit IS NOT NULL)::BIGINT + 2 * (capex IS NOT NULL)::BIGINT + 3 * (cash IS NOT NULL)::BIGINT + 3 * (other IS NOT NULL)::BIGINT AS facts,
  revenue::DOUBLE AS revenue, ebit::DOUBLE AS ebit, (10 + CASE WHEN capex <> 10 THEN capex ELSE 0 END)::DOUBLE AS capex, cash::DOUBLE AS cash, other::DOUBLE AS debt,
  CASE WHEN other IS NOT NULL OR cash IS NOT NULL THEN coalesce(other, 0) - coalesce(cash, 0) END::DOUBLE AS nwc,
  1 + (revenue IS NOT NULL)::BIGINT + (ebit IS NOT NULL)::BIGINT + (cash IS NOT NULL)::BIGINT + (other IS NOT NULL)::BIGINT + (other IS NOT NULL OR cash IS NOT NULL)::BIGINT AS covered FROM s""",
}
