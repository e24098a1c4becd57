"""Returns on capital of issuers, with what they spend on intangibles as an asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.capital import capital_profile, capital_returns
from tidemark.plans.companies import WIDE_SQL, fundamentals

TAX, LIFE = 0.25, 3


def _periods(spark, sf_dir: str) -> DataFrame:
    """Years of issuers with revenue and profit; what they hold in cash stands for research."""
    rows = fundamentals(spark, sf_dir).filter("revenue is not null and ebit is not null")
    return rows.select(
        "issuer", "fiscal_year", (F.col("ebit") * (1 - TAX)).alias("nopat"), F.col("revenue").alias("capital"), F.col("capex").alias("reinvestment"), F.col("cash").alias("research"), F.lit(None).cast("double").alias("sga"),
        F.col("capex").alias("acquisitions"), F.col("cash").alias("buybacks"), F.col("ebit").alias("dividends"),
    )


def returns(spark, sf_dir: str) -> DataFrame:
    """Reported and adjusted returns, incremental ones, and rates of reinvestment, year by year."""
    out = capital_returns(_periods(spark, sf_dir), ["issuer"], "fiscal_year", LIFE, TAX)
    return out.select("issuer", "fiscal_year", *(F.round(c, 2).alias(c) for c in ("amortization", "asset")), *(F.round(c, 6).alias(c) for c in ("roic", "adjusted_roic", "roiic", "adjusted_roiic", "reinvestment_rate", "adjusted_reinvestment_rate")))


def profiles(spark, sf_dir: str) -> DataFrame:
    """An issuer's median and latest returns, and what it spent in all."""
    rows = _periods(spark, sf_dir)
    out = capital_profile(capital_returns(rows, ["issuer"], "fiscal_year", LIFE, TAX), rows, ["issuer"], "fiscal_year")
    return out.select("issuer", "periods", *(F.round(c, 6).alias(c) for c in ("median_roic", "median_adjusted_roic", "latest_roiic", "latest_adjusted_roiic")), *(F.round(c, 2).alias(c) for c in ("acquisitions", "buybacks", "dividends")))


QUERIES = {"capital_returns": returns, "capital_profiles": profiles}

#: Each year meets the years before it, one by one.
_RETURNS = WIDE_SQL + """,
b AS (SELECT issuer, fiscal_year AS y, ebit * 0.75 AS nopat, revenue AS capital, capex AS k, coalesce(cash, 0) AS i, capex, cash, ebit FROM wide WHERE revenue IS NOT NULL AND ebit IS NOT NULL),
v AS (SELECT b.issuer, b.y, coalesce(sum(p.i) FILTER (WHERE b.y - p.y BETWEEN 1 AND 3), 0) / 3 AS am, sum(p.i * (3 - (b.y - p.y)) / 3.0) FILTER (WHERE b.y - p.y BETWEEN 0 AND 2) AS asset
  FROM b JOIN b AS p ON b.issuer = p.issuer AND p.y <= b.y GROUP BY 1, 2),
a AS (SELECT b.*, am, asset, nopat + (i - am) * 0.75 AS an, capital + asset AS ac, k + i - am AS ak FROM b JOIN v USING (issuer, y)),
r AS (SELECT *, nopat / nullif(capital, 0) AS roic, an / nullif(ac, 0) AS adjusted_roic, (nopat - lag(nopat) OVER w) / nullif(k, 0) AS roiic, CASE WHEN k <> 0 THEN (an - lag(an) OVER w) / nullif(ak, 0) END AS adjusted_roiic,
  k / nullif(nopat, 0) AS rate, ak / nullif(an, 0) AS adjusted_rate FROM a WINDOW w AS (PARTITION BY issuer ORDER BY y))"""

ORACLE_SQL = {
    "capital_returns": _RETURNS + """
SELECT issuer, y AS fiscal_year, round(am, 2) AS amortization, round(asset, 2) AS asset, round(roic, 6) AS roic, round(adjusted_roic, 6) AS adjusted_roic, round(roiic, 6) AS roiic, round(adjusted_roiic, 6) AS adjusted_roiic,
  round(rate, 6) AS reinvestment_rate, round(adjusted_rate, 6) AS adjusted_reinvestment_rate FROM r""",
    "capital_profiles": _RETURNS + """
SELECT issuer, count(*) AS periods, round(median(roic), 6) AS median_roic, round(median(adjusted_roic), 6) AS median_adjusted_roic, round(arg_max_null(roiic, y), 6) AS latest_roiic, round(arg_max_null(adjusted_roiic, y), 6) AS latest_adjusted_roiic,
  round(coalesce(sum(capex), 0), 2) AS acquisitions, round(coalesce(sum(cash), 0), 2) AS buybacks, round(sum(ebit), 2) AS dividends FROM r GROUP BY 1""",
}
