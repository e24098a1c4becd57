"""Queries over prices, signals and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ranks import average_rank, rank_correlation, winsorize
from tidemark.plans.views import changes, held_signals, near_signal_dates, prices, securities, signals, with_views
from tidemark.sources.scratch import materialize

HOLD_DAYS, STALE_DAYS = 77, 10


def entry_prices(spark, sf_dir: str) -> DataFrame:
    """Signals with the last price at or before their date, at most ``STALE_DAYS`` old."""
    return asof_join(signals(spark, sf_dir), prices(spark, sf_dir), ["ticker"], "signal_date", "price_date", ["close"], within_days=STALE_DAYS)


def entry_prices_forward(spark, sf_dir: str) -> DataFrame:
    return asof_join(signals(spark, sf_dir), prices(spark, sf_dir), ["ticker"], "signal_date", "price_date", ["close"], forward=True, within_days=STALE_DAYS)


def forward_returns(spark, sf_dir: str) -> DataFrame:
    """Return from the entry price to the last price ``HOLD_DAYS`` later; null without either."""
    return _entered(spark, sf_dir).drop("entry_close")


def _entered(spark, sf_dir: str) -> DataFrame:
    held = held_signals(spark, sf_dir, HOLD_DAYS, STALE_DAYS)
    return held.select("signal_date", "ticker", "signal", F.round(F.col("exit_close") / F.col("entry_close") - 1, 6).alias("forward_return"), "entry_close")


def entered_panel(spark, sf_dir: str) -> DataFrame:
    """``panel`` with the entry price. Read for the cuts and again to be cut, so the returns are written once."""
    rows = materialize(_entered(spark, sf_dir).filter("forward_return is not null"), "entered")
    return winsorize(rows, "forward_return", ["signal_date"]).join(securities(spark, sf_dir).select("ticker", "sector"), "ticker")


def panel(spark, sf_dir: str) -> DataFrame:
    return entered_panel(spark, sf_dir).drop("entry_close")


def winsorized_returns(spark, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("signal_date", "ticker", F.round("forward_return", 6).alias("forward_return"))


def signal_ic_by_date(spark, sf_dir: str) -> DataFrame:
    """Rank IC, sector-neutral rank IC and the spread of the tails, per signal date; all ranks in one pass over the panel."""
    inside, date = Window.partitionBy("signal_date", "sector"), ["signal_date"]
    rows = panel(spark, sf_dir).withColumns({
        "s": F.round(F.col("signal") - F.avg("signal").over(inside), 9), "f": F.round(F.col("forward_return") - F.avg("forward_return").over(inside), 9),
    })
    ranked = rows.withColumns({f"r_{c}": average_rank(c, date) for c in ("signal", "forward_return", "s", "f")})
    placed = ranked.withColumns({"r": F.row_number().over(Window.partitionBy(*date).orderBy("signal", F.sha2("ticker", 256))), "n": F.count("*").over(Window.partitionBy(*date))})
    tail = F.floor(F.col("n") / 5)
    high, low = F.avg(F.when(F.col("r") > F.col("n") - tail, F.col("forward_return"))), F.avg(F.when(F.col("r") <= tail, F.col("forward_return")))
    return placed.groupBy(*date).agg(
        F.count("*").alias("n"), F.round(rank_correlation("r_signal", "r_forward_return"), 6).alias("ic"), F.round(rank_correlation("r_s", "r_f"), 6).alias("neutral_ic"),
        F.max(tail).alias("tail_n"), F.round(high - low, 6).alias("spread"),
    )


def rank_percentiles(spark, sf_dir: str) -> DataFrame:
    """Average rank over n, and from 0 to 100 with 50 for a single row."""
    rows = signals(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("signal_date"))
    ranked = rows.withColumns({"r": average_rank("signal", ["signal_date"]), "n": n})
    spread = F.when(F.col("n") > 1, 100 * (F.col("r") - 1) / (F.col("n") - 1)).otherwise(50.0)
    return ranked.select("signal_date", "ticker", F.round(F.col("r") / F.col("n"), 6).alias("share"), F.round(spread, 6).alias("percentile"))


def momentum(spark, sf_dir: str, least: int = 20) -> DataFrame:
    """Compounded price change over days (t-365, t-30], with at least ``least`` prices; full daily panels ask for 120, these tables have some 80 a year."""
    near = changes(spark, sf_dir).withColumn("signal_date", F.explode(near_signal_dates("price_date", 30, 365)))
    sums = near.groupBy("signal_date", "ticker").agg(F.count("*").alias("n"), F.sum(F.log1p("change")).alias("s"))
    return sums.filter(F.col("n") >= least).select("signal_date", "ticker", "n", F.round(F.exp("s") - 1, 6).alias("momentum"))


def market_returns(spark, sf_dir: str) -> DataFrame:
    """Equally weighted daily change by market, each capped at 30 %."""
    joined = changes(spark, sf_dir).join(securities(spark, sf_dir), "ticker")
    return joined.groupBy("market", "price_date").agg(F.count("*").alias("n"), F.round(F.avg("change"), 6).alias("change"))


def size_terciles(spark, sf_dir: str) -> DataFrame:
    """Three size buckets by market value at the last price; ties by ticker."""
    last = prices(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "price_date").alias("close"))
    valued = last.join(securities(spark, sf_dir), "ticker").withColumn("value", F.round(F.col("close") * F.col("shares"), 4))
    everyone = Window.partitionBy("market")
    r, n = F.row_number().over(everyone.orderBy("value", "ticker")), F.count("*").over(everyone)
    bucket = F.when(n > 1, F.least(F.lit(3), F.floor((r - 1) * 3 / (n - 1)) + 1)).otherwise(1)
    return valued.select("market", "ticker", "value", bucket.cast("int").alias("tercile"))


def drawdowns(spark, sf_dir: str) -> DataFrame:
    """Each price against the highest one so far."""
    so_far = Window.partitionBy("ticker").orderBy("price_date").rowsBetween(Window.unboundedPreceding, 0)
    return prices(spark, sf_dir).select("ticker", "price_date", F.round(F.col("close") / F.max("close").over(so_far) - 1, 6).alias("drawdown"))


QUERIES = {
    "asof_price_backward": entry_prices,
    "asof_price_forward": entry_prices_forward,
    "forward_return_77d": forward_returns,
    "winsorize_returns": winsorized_returns,
    "signal_ic_by_date": signal_ic_by_date,
    "avg_rank_percentile": rank_percentiles,
    "momentum_12_1": momentum,
    "market_equal_weight_return": market_returns,
    "size_tercile": size_terciles,
    "drawdown_curve": drawdowns,
}

RETURNS_SQL = with_views("securities", "prices", "dates", "signals") + """,
e AS (SELECT s.*, p.close AS entry_close FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.signal_date >= p.price_date
      WHERE s.signal_date - p.price_date <= 10 OR p.price_date IS NULL),
x AS (SELECT s.signal_date, s.ticker, s.signal, e.entry_close, s.signal_date + 77 AS exit_at FROM signals s LEFT JOIN e USING (signal_date, ticker)),
fr AS (SELECT x.signal_date, x.ticker, x.signal, CASE WHEN x.exit_at - p.price_date <= 10 THEN round(p.close / x.entry_close - 1, 6) END AS forward_return
      FROM x ASOF LEFT JOIN prices p ON x.ticker = p.ticker AND x.exit_at >= p.price_date)"""
PANEL_SQL = RETURNS_SQL + """,
q AS (SELECT signal_date, quantile_cont(forward_return, 0.01) AS lo, quantile_cont(forward_return, 0.99) AS hi FROM fr WHERE forward_return IS NOT NULL GROUP BY 1),
panel AS (SELECT signal_date, ticker, signal, greatest(lo, least(hi, forward_return)) AS forward_return, sector FROM fr JOIN q USING (signal_date) JOIN securities USING (ticker) WHERE forward_return IS NOT NULL)"""
CHANGES_SQL = """changes AS (SELECT ticker, price_date, greatest(-0.3, least(0.3, close / last - 1)) AS change
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY price_date) AS last FROM prices) WHERE last IS NOT NULL)"""

ORACLE_SQL = {
    "asof_price_backward": with_views("prices", "dates", "signals") + """
SELECT s.ticker, s.signal_date, s.signal, CASE WHEN s.signal_date - p.price_date <= 10 THEN p.price_date END AS price_date, CASE WHEN s.signal_date - p.price_date <= 10 THEN p.close END AS close
FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.signal_date >= p.price_date""",
    "asof_price_forward": with_views("prices", "dates", "signals") + """
SELECT s.ticker, s.signal_date, s.signal, CASE WHEN p.price_date - s.signal_date <= 10 THEN p.price_date END AS price_date, CASE WHEN p.price_date - s.signal_date <= 10 THEN p.close END AS close
FROM signals s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.signal_date <= p.price_date""",
    "forward_return_77d": RETURNS_SQL + "\nSELECT signal_date, ticker, signal, forward_return FROM fr",
    "winsorize_returns": PANEL_SQL + "\nSELECT signal_date, ticker, round(forward_return, 6) AS forward_return FROM panel",
    "signal_ic_by_date": PANEL_SQL + """,
ntr AS (SELECT signal_date, ticker, signal, forward_return, round(signal - avg(signal) OVER w, 9) AS s, round(forward_return - avg(forward_return) OVER w, 9) AS f FROM panel WINDOW w AS (PARTITION BY signal_date, sector)),
rk AS (SELECT *, rank() OVER (PARTITION BY signal_date ORDER BY signal) + (count(*) OVER (PARTITION BY signal_date, signal) - 1) / 2 AS rs,
        rank() OVER (PARTITION BY signal_date ORDER BY forward_return) + (count(*) OVER (PARTITION BY signal_date, forward_return) - 1) / 2 AS rf,
        rank() OVER (PARTITION BY signal_date ORDER BY s) + (count(*) OVER (PARTITION BY signal_date, s) - 1) / 2 AS ns,
        rank() OVER (PARTITION BY signal_date ORDER BY f) + (count(*) OVER (PARTITION BY signal_date, f) - 1) / 2 AS nf,
        row_number() OVER (PARTITION BY signal_date ORDER BY signal, sha256(ticker)) AS r, count(*) OVER (PARTITION BY signal_date) AS c FROM ntr)
SELECT signal_date, count(*) AS n,
  CASE WHEN count(*) >= 5 AND min(rs) < max(rs) AND min(rf) < max(rf) THEN round(corr(rs, rf), 6) END AS ic,
  CASE WHEN count(*) >= 5 AND min(ns) < max(ns) AND min(nf) < max(nf) THEN round(corr(ns, nf), 6) END AS neutral_ic,
  max(c // 5) AS tail_n, round(avg(forward_return) FILTER (WHERE r > c - c // 5) - avg(forward_return) FILTER (WHERE r <= c // 5), 6) AS spread
FROM rk GROUP BY 1""",
    "avg_rank_percentile": with_views("prices", "dates", "signals") + """,
r AS (SELECT signal_date, ticker, rank() OVER (PARTITION BY signal_date ORDER BY signal) + (count(*) OVER (PARTITION BY signal_date, signal) - 1) / 2 AS r, count(*) OVER (PARTITION BY signal_date) AS n FROM signals)
SELECT signal_date, ticker, round(r / n, 6) AS share, round(CASE WHEN n > 1 THEN 100 * (r - 1) / (n - 1) ELSE 50.0 END, 6) AS percentile FROM r""",
    "momentum_12_1": with_views("prices", "dates", "signals") + ",\n" + CHANGES_SQL + """,
d AS (SELECT DISTINCT signal_date FROM signals)
SELECT signal_date, ticker, count(*) AS n, round(exp(sum(ln(1 + change))) - 1, 6) AS momentum
FROM changes JOIN d ON signal_date - price_date >= 30 AND signal_date - price_date < 365 GROUP BY 1, 2 HAVING count(*) >= 20""",
    "market_equal_weight_return": with_views("securities", "prices") + ",\n" + CHANGES_SQL + """
SELECT market, price_date, count(*) AS n, round(avg(change), 6) AS change FROM changes JOIN securities USING (ticker) GROUP BY 1, 2""",
    "size_tercile": with_views("securities", "prices") + """,
v AS (SELECT market, ticker, round(arg_max(close, price_date) * any_value(shares), 4) AS value FROM prices JOIN securities USING (ticker) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY value, ticker) AS r, count(*) OVER (PARTITION BY market) AS n FROM v)
SELECT market, ticker, value, CASE WHEN n > 1 THEN least(3, (r - 1) * 3 // (n - 1) + 1) ELSE 1 END::INTEGER AS tercile FROM r""",
    "drawdown_curve": with_views("prices") + """
SELECT ticker, price_date, round(close / max(close) OVER (PARTITION BY ticker ORDER BY price_date) - 1, 6) AS drawdown FROM prices""",
}
