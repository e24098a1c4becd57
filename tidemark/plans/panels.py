"""Queries over signal panels: inference, buckets, neutralisation, universes and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.inference import holm, interval_join, newey_west, rank_bucket, residual, two_sided_p
from tidemark.operators.ranks import average_rank
from tidemark.plans import market
from tidemark.plans.views import changes, near_signal_dates, prices, sector_intervals, securities, signals, with_views

HAC_LAGS, BETA_ROWS, BETA_LEAST, SESSIONS = 4, 252, 120, 63
#: Names held in each market, names sampled from each stratum, and the seed of the sample.
HELD, SAMPLED, SEED = 3, 3, "42"


def hac_mean(spark, sf_dir: str) -> DataFrame:
    """Mean daily change of each market with an error that allows for autocorrelation."""
    out = newey_west(market.market_returns(spark, sf_dir), "change", "price_date", ["market"], HAC_LAGS)
    return out.select("market", "n", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), F.round("t", 4).alias("t"))


def holm_by_market(spark, sf_dir: str) -> DataFrame:
    """Whether each sector's mean daily change differs from zero, adjusted for the sectors of its market."""
    rows = changes(spark, sf_dir).join(securities(spark, sf_dir), "ticker")
    tested = rows.groupBy("market", "sector").agg(F.count("*").alias("n"), F.try_divide(F.avg("change") * F.sqrt(F.count("*")), F.stddev_samp("change")).alias("t"))
    adjusted = holm(tested.withColumn("p", F.round(two_sided_p(F.col("t")), 8)), "p", ["market"], "sector")
    return adjusted.select("market", "sector", "n", F.round("t", 4).alias("t"), "p", F.round("adjusted", 8).alias("adjusted"))


def top_hhi(spark, sf_dir: str) -> DataFrame:
    """Concentration of sectors among the fifth of names with the highest signal."""
    date = Window.partitionBy("signal_date")
    rows = signals(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "sector"), "ticker")
    placed = rows.withColumns({"r": F.row_number().over(date.orderBy(F.desc("signal"), "ticker")), "n": F.count("*").over(date)})
    top = placed.filter(F.col("r") <= F.ceil(F.col("n") / 5)).groupBy("signal_date", "sector").agg(F.count("*").alias("c"))
    return top.groupBy("signal_date").agg(F.sum("c").alias("names"), F.round(F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2)), 6).alias("hhi"))


def quintiles(spark, sf_dir: str) -> DataFrame:
    """Mean forward return of the outer fifths by rank and their difference, from ten names a date."""
    rows = market.forward_returns(spark, sf_dir).filter("forward_return is not null")
    placed = rows.withColumn("q", rank_bucket("signal", ["signal_date"], "ticker", 5))
    mean = lambda q: F.avg(F.when(F.col("q") == q, F.col("forward_return")))
    out = placed.groupBy("signal_date").agg(F.count("*").alias("n"), mean(1).alias("q1"), mean(5).alias("q5")).filter("n >= 10")
    return out.select("signal_date", "n", *(F.round(c, 10).alias(c) for c in ("q1", "q5")), F.round(F.col("q5") - F.col("q1"), 10).alias("spread"))


def residual_returns(spark, sf_dir: str) -> DataFrame:
    """Forward returns less what the signal explains on the date."""
    rows = market.forward_returns(spark, sf_dir).filter("forward_return is not null")
    return rows.select("signal_date", "ticker", F.round(residual("forward_return", "signal", ["signal_date"]), 6).alias("residual"))


def beta(spark, sf_dir: str) -> DataFrame:
    """Slope on the market's change over the last rows of each ticker; null with too few pairs."""
    whole = market.market_returns(spark, sf_dir).select("market", "price_date", F.col("change").alias("whole"))
    rows = changes(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "market"), "ticker").join(whole, ["market", "price_date"])
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("price_date")))).filter(F.col("r") <= BETA_ROWS)
    slope = F.when(F.count("*") >= BETA_LEAST, F.try_divide(F.covar_samp("change", "whole"), F.var_samp("whole")))
    return last.groupBy("ticker").agg(F.count("*").alias("n"), F.round(slope, 6).alias("beta"))


def statistics(spark, sf_dir: str) -> DataFrame:
    """Count, mean, deviation, t and share of gains of forward returns by date."""
    rows = market.forward_returns(spark, sf_dir).filter("forward_return is not null")
    n, mean, sd = F.count("*"), F.avg("forward_return"), F.stddev_samp("forward_return")
    t, gains = F.try_divide(mean * F.sqrt(n), sd), F.avg((F.col("forward_return") > 0).cast("int"))
    return rows.groupBy("signal_date").agg(n.alias("n"), F.round(mean, 10).alias("mean"), F.round(sd, 8).alias("sd"), F.round(t, 4).alias("t"), F.round(gains, 6).alias("gains"))


def coverage(spark, sf_dir: str) -> DataFrame:
    """Signals against securities by date and sector."""
    names = securities(spark, sf_dir)
    listed = names.groupBy("sector").agg(F.count("*").alias("listed"))
    seen = signals(spark, sf_dir).join(names, "ticker").groupBy("signal_date", "sector").agg(F.count("*").alias("covered"))
    return seen.join(listed, "sector").select("signal_date", "sector", "listed", "covered", F.round(F.col("covered") / F.col("listed"), 6).alias("share"))


def sample(spark, sf_dir: str) -> DataFrame:
    """The first names of each market and size bucket in the order of a seeded hash."""
    order = Window.partitionBy("market", "tercile").orderBy(F.sha2(F.concat(F.lit(SEED + "|"), "ticker"), 256))
    return market.size_terciles(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLED).select("market", "tercile", "ticker", "r")


def liquidity(spark, sf_dir: str) -> DataFrame:
    """Amount traded over 60 days, as a percentile of the date's names."""
    near = prices(spark, sf_dir).withColumn("signal_date", F.explode(near_signal_dates("price_date", 0, 60)))
    known = signals(spark, sf_dir).select("signal_date").distinct()
    sums = near.join(F.broadcast(known), "signal_date").groupBy("signal_date", "ticker").agg(F.round(F.sum("amount"), 2).alias("traded"))
    n = F.count("*").over(Window.partitionBy("signal_date"))
    return sums.select("signal_date", "ticker", "traded", F.round(average_rank("traded", ["signal_date"]) / n, 6).alias("percentile"))


def sessions(spark, sf_dir: str) -> DataFrame:
    """Each market's session that is ``SESSIONS`` later; null near the end."""
    days = prices(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "market"), "ticker").select("market", "price_date").distinct()
    return days.select("market", "price_date", F.lead("price_date", SESSIONS).over(Window.partitionBy("market").orderBy("price_date")).alias("later"))


def sectors_known(spark, sf_dir: str) -> DataFrame:
    """The sector in force and published at each signal's date."""
    asked = signals(spark, sf_dir).select("ticker", "signal_date").distinct()
    return interval_join(asked, sector_intervals(spark, sf_dir), ["ticker"], "signal_date", "effective_from", "effective_to", "published", ["sector"])


def _held(spark, sf_dir: str) -> DataFrame:
    rows = market.forward_returns(spark, sf_dir).filter("forward_return is not null").join(securities(spark, sf_dir).select("ticker", "market"), "ticker")
    order = Window.partitionBy("market", "signal_date").orderBy(F.desc("signal"), "ticker")
    top = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= HELD)
    earned = top.groupBy("market", "signal_date").agg(F.count("*").alias("names"), F.round(F.avg("forward_return"), 9).alias("earned"))
    so_far = Window.partitionBy("market").orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)
    grown = earned.withColumn("equity", F.exp(F.sum(F.log1p("earned")).over(so_far)))
    return grown.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(so_far)) - 1)


def backtest(spark, sf_dir: str) -> DataFrame:
    """Equal weights in each market's names with the highest signals: return, equity and drawdown by date."""
    return _held(spark, sf_dir).select("market", "signal_date", "names", *(F.round(c, 6).alias(c) for c in ("earned", "equity", "drawdown")))


def performance(spark, sf_dir: str) -> DataFrame:
    """Each market's total return, deviation and deepest drawdown."""
    out = _held(spark, sf_dir).groupBy("market").agg(
        F.count("*").alias("periods"), F.round(F.max_by("equity", "signal_date") - 1, 6).alias("total"), F.round(F.stddev_samp("earned"), 6).alias("deviation"), F.round(F.min("drawdown"), 6).alias("deepest")
    )
    return out


QUERIES = {
    "newey_west_mean": hac_mean,
    "holm_adjust": holm_by_market,
    "top_sector_hhi": top_hhi,
    "quintile_qcut_spread": quintiles,
    "residualize_one_control": residual_returns,
    "beta_252": beta,
    "sample_statistics": statistics,
    "coverage_segments": coverage,
    "stratified_hash_sample": sample,
    "liquidity_percentile": liquidity,
    "session_plus_63": sessions,
    "sector_interval_asof": sectors_known,
    "backtest_equal_weight": backtest,
    "backtest_performance": performance,
}

_CHANGED = with_views("securities", "prices") + ",\n" + market.CHANGES_SQL
_MARKET = _CHANGED + """,
m AS (SELECT market, price_date, round(avg(change), 6) AS change FROM changes JOIN securities USING (ticker) GROUP BY 1, 2)"""
_KNOWN = market.RETURNS_SQL + ",\nk AS (SELECT * FROM fr WHERE forward_return IS NOT NULL)"
_HELD = _KNOWN + """,
top AS (SELECT market, signal_date, forward_return FROM k JOIN securities USING (ticker) QUALIFY row_number() OVER (PARTITION BY market, signal_date ORDER BY signal DESC, ticker) <= 3),
b AS (SELECT market, signal_date, count(*) AS names, round(avg(forward_return), 9) AS earned FROM top GROUP BY 1, 2),
q AS (SELECT *, exp(sum(ln(1 + earned)) OVER (PARTITION BY market ORDER BY signal_date)) AS equity FROM b),
held AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY market ORDER BY signal_date)) - 1 AS drawdown FROM q)"""

ORACLE_SQL = {
    "newey_west_mean": _MARKET + """,
e AS (SELECT market, price_date, avg(change) OVER w AS m, change - avg(change) OVER w AS e, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY market)),
l AS (SELECT market, m, n, e * e + 2 * (greatest(0, 1 - 1 / (least(4, n - 1) + 1)) * coalesce(e * lag(e, 1) OVER o, 0) + greatest(0, 1 - 2 / (least(4, n - 1) + 1)) * coalesce(e * lag(e, 2) OVER o, 0)
  + greatest(0, 1 - 3 / (least(4, n - 1) + 1)) * coalesce(e * lag(e, 3) OVER o, 0) + greatest(0, 1 - 4 / (least(4, n - 1) + 1)) * coalesce(e * lag(e, 4) OVER o, 0)) AS v FROM e WINDOW o AS (PARTITION BY market ORDER BY price_date)),
s AS (SELECT market, max(n) AS n, max(m) AS mean, sqrt(greatest(0, sum(v))) / max(n) AS se FROM l GROUP BY 1)
SELECT market, n, round(mean, 8) AS mean, round(se, 8) AS se, round(CASE WHEN se > 0 THEN mean / se END, 4) AS t FROM s""",
    "holm_adjust": _CHANGED + """,
t AS (SELECT market, sector, count(*) AS n, avg(change) * sqrt(count(*)) / nullif(stddev_samp(change), 0) AS t FROM changes JOIN securities USING (ticker) GROUP BY 1, 2),
x AS (SELECT *, abs(t) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) AS u FROM t WHERE t IS NOT NULL),
p AS (SELECT *, round(least(1, ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-x * x)), 8) AS p FROM x),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY market) - row_number() OVER (PARTITION BY market ORDER BY p, sector) + 1) * p) AS step FROM p)
SELECT market, sector, n, round(t, 4) AS t, p, round(max(step) OVER (PARTITION BY market ORDER BY p, sector ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM s""",
    "top_sector_hhi": with_views("securities", "prices", "dates", "signals") + """,
r AS (SELECT signal_date, sector, row_number() OVER (PARTITION BY signal_date ORDER BY signal DESC, ticker) AS r, count(*) OVER (PARTITION BY signal_date) AS n FROM signals JOIN securities USING (ticker)),
c AS (SELECT signal_date, sector, count(*) AS c FROM r WHERE r <= ceil(n / 5) GROUP BY 1, 2)
SELECT signal_date, sum(c)::BIGINT AS names, round(sum(c * c) / pow(sum(c), 2), 6) AS hhi FROM c GROUP BY 1""",
    "quintile_qcut_spread": _KNOWN + """,
r AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY signal, ticker) AS r, count(*) OVER (PARTITION BY signal_date) AS n FROM k),
q AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, ceil((r - 1) * 5 / (n - 1))) ELSE 1 END AS q FROM r)
SELECT signal_date, count(*) AS n, round(avg(forward_return) FILTER (WHERE q = 1), 10) AS q1, round(avg(forward_return) FILTER (WHERE q = 5), 10) AS q5,
  round(avg(forward_return) FILTER (WHERE q = 5) - avg(forward_return) FILTER (WHERE q = 1), 10) AS spread FROM q GROUP BY 1 HAVING count(*) >= 10""",
    "residualize_one_control": _KNOWN + """
SELECT signal_date, ticker, round(forward_return - avg(forward_return) OVER w - coalesce(covar_pop(forward_return, signal) OVER w / nullif(var_pop(signal) OVER w, 0), 0) * (signal - avg(signal) OVER w), 6) AS residual
FROM k WINDOW w AS (PARTITION BY signal_date)""",
    "beta_252": _MARKET + """,
j AS (SELECT ticker, changes.change, m.change AS whole FROM changes JOIN securities USING (ticker) JOIN m USING (market, price_date) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY price_date DESC) <= 252)
SELECT ticker, count(*) AS n, round(CASE WHEN count(*) >= 120 THEN covar_samp(change, whole) / nullif(var_samp(whole), 0) END, 6) AS beta FROM j GROUP BY 1""",
    "sample_statistics": _KNOWN + """
SELECT signal_date, count(*) AS n, round(avg(forward_return), 10) AS mean, round(stddev_samp(forward_return), 8) AS sd, round(avg(forward_return) * sqrt(count(*)) / nullif(stddev_samp(forward_return), 0), 4) AS t,
  round(avg((forward_return > 0)::INTEGER), 6) AS gains FROM k GROUP BY 1""",
    "coverage_segments": with_views("securities", "prices", "dates", "signals") + """,
l AS (SELECT sector, count(*) AS listed FROM securities GROUP BY 1), c AS (SELECT signal_date, sector, count(*) AS covered FROM signals JOIN securities USING (ticker) GROUP BY 1, 2)
SELECT signal_date, sector, listed, covered, round(covered / listed, 6) AS share FROM c JOIN l USING (sector)""",
    "stratified_hash_sample": with_views("securities", "prices") + """,
v AS (SELECT market, ticker, round(arg_max(close, price_date) * any_value(shares), 4) AS value FROM prices JOIN securities USING (ticker) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY value, ticker) AS r, count(*) OVER (PARTITION BY market) AS n FROM v),
t AS (SELECT market, ticker, CASE WHEN n > 1 THEN least(3, (r - 1) * 3 // (n - 1) + 1) ELSE 1 END::INTEGER AS tercile FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY market, tercile ORDER BY sha256('42|' || ticker))::INTEGER AS r FROM t)
SELECT market, tercile, ticker, r FROM o WHERE r <= 3""",
    "liquidity_percentile": with_views("prices", "dates", "signals") + """,
d AS (SELECT DISTINCT signal_date FROM signals),
s AS (SELECT signal_date, ticker, round(sum(amount), 2) AS traded FROM prices JOIN d ON signal_date - price_date >= 0 AND signal_date - price_date < 60 GROUP BY 1, 2)
SELECT signal_date, ticker, traded, round((rank() OVER (PARTITION BY signal_date ORDER BY traded) + (count(*) OVER (PARTITION BY signal_date, traded) - 1) / 2) / count(*) OVER (PARTITION BY signal_date), 6) AS percentile FROM s""",
    "session_plus_63": with_views("securities", "prices") + """,
d AS (SELECT DISTINCT market, price_date FROM prices JOIN securities USING (ticker))
SELECT market, price_date, lead(price_date, 63) OVER (PARTITION BY market ORDER BY price_date) AS later FROM d""",
    "sector_interval_asof": with_views("prices", "dates", "signals", "sector_intervals") + """,
j AS (SELECT s.ticker, s.signal_date, i.sector, i.effective_from, i.published FROM signals s LEFT JOIN sector_intervals i ON s.ticker = i.ticker AND i.effective_from <= s.signal_date
  AND (i.effective_to IS NULL OR i.effective_to >= s.signal_date) AND i.published <= s.signal_date)
SELECT ticker, signal_date, sector FROM j QUALIFY row_number() OVER (PARTITION BY ticker, signal_date ORDER BY effective_from DESC, published DESC) = 1""",
    "backtest_equal_weight": _HELD + "\nSELECT market, signal_date, names, round(earned, 6) AS earned, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM held",
    "backtest_performance": _HELD + """
SELECT market, count(*) AS periods, round(arg_max(equity, signal_date) - 1, 6) AS total, round(stddev_samp(earned), 6) AS deviation, round(min(drawdown), 6) AS deepest FROM held GROUP BY 1""",
}
