"""Queries over signal panels: ties, residuals, resampling, clustered errors, quantiles and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import inference
from tidemark.operators.ranks import average_rank, rank_correlation
from tidemark.plans import market
from tidemark.plans.views import changes, prices, securities, signals, with_views

SIMULATIONS, TIE_SEED = 1000, "ties-v1"
BOOT_BLOCK, BOOT_REPEATS, BOOT_SEED = 4, 10_000, "boot-v1"
#: Sectors with fewer names are pooled, and so are unknown ones.
RARE_SECTOR = 5
HORIZONS = (77, 182, 365, 730)
STALE_DAYS = 10
DATE = ["signal_date"]


def _coarse(spark, sf_dir: str) -> DataFrame:
    """The panel with signals to one digit, so that ties occur."""
    return market.panel(spark, sf_dir).withColumn("signal", F.round("signal", 1))


def hashed_ties(spark, sf_dir: str) -> DataFrame:
    """Spread of equal tails, averaged over random orders of equal signals."""
    out = inference.tie_averaged_spread(_coarse(spark, sf_dir), "signal", "forward_return", DATE, "ticker", SIMULATIONS, TIE_SEED)
    return out.select("signal_date", "tail_n", F.round("spread", 8).alias("spread"))


def ties(spark, sf_dir: str) -> DataFrame:
    out = inference.tie_diagnostics(_coarse(spark, sf_dir), "signal", DATE)
    return out.withColumn("largest_share", F.round("largest_share", 8))


def neutral_without_singletons(spark, sf_dir: str) -> DataFrame:
    """Rank IC of values less their sector's mean, without sectors of one name; null below three names."""
    inside = Window.partitionBy("signal_date", "sector")
    rows = market.panel(spark, sf_dir).withColumn("c", F.count("*").over(inside))
    some = rows.filter("c >= 2").withColumns({c: F.round(F.col(c) - F.avg(c).over(inside), 9) for c in ("signal", "forward_return")})
    ranked = some.withColumns({"x": average_rank("signal", DATE), "y": average_rank("forward_return", DATE)})
    ic = ranked.groupBy(*DATE).agg(F.count("*").alias("n"), F.count_distinct("sector").alias("sectors"), F.round(rank_correlation("x", "y", 3), 6).alias("ic"))
    left_out = rows.groupBy(*DATE).agg(F.count_if(F.col("c") < 2).alias("singletons"))
    return left_out.join(ic, "signal_date", "left").fillna(0, ["n", "sectors"])


def _controlled(spark, sf_dir: str) -> DataFrame:
    """The panel with two controls: the logarithm of the entry price and of the name's shares."""
    rows = market.entered_panel(spark, sf_dir).withColumn("log_price", F.ln("entry_close")).drop("entry_close")
    size = securities(spark, sf_dir).select("ticker", F.ln("shares").alias("log_shares"))
    return rows.join(size, "ticker")


def two_controls(spark, sf_dir: str) -> DataFrame:
    """Signals less what price and size explain on the date, by successive projections."""
    out = inference.residual_of(_controlled(spark, sf_dir), "signal", ["log_price", "log_shares"], DATE)
    return out.select("signal_date", "ticker", F.round("residual", 6).alias("residual"))


def normal_scores(spark, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("signal_date", "ticker", F.round(inference.rank_normal("signal", DATE), 6).alias("score"))


def with_dummies(spark, sf_dir: str) -> DataFrame:
    """Normal scores of signals less what price and sectors explain; null where a date has too few names."""
    rows = _controlled(spark, sf_dir)
    scored = rows.withColumns({"y": F.round(inference.rank_normal("signal", DATE), 9), "x": F.round(inference.rank_normal("log_price", DATE), 9), "n": F.count("*").over(Window.partitionBy(*DATE))})
    out = inference.residual_of(scored, "y", ["x"], DATE, within=[*DATE, "sector"])
    return out.select("signal_date", "ticker", F.when(F.col("n") > 3, F.round("residual", 6)).alias("residual"))


def bootstrap(spark, sf_dir: str) -> DataFrame:
    """Interval of each market's mean weekly change by resampled blocks of neighbouring weeks."""
    week = F.date_trunc("week", "price_date").cast("date").alias("week")
    weekly = market.market_returns(spark, sf_dir).groupBy("market", week).agg(F.round(F.avg("change"), 9).alias("change"))
    out = inference.block_bootstrap(weekly, "change", "week", ["market"], BOOT_BLOCK, BOOT_REPEATS, BOOT_SEED)
    return out.select("market", "n", *(F.round(c, 7).alias(c) for c in ("mean", "low", "high")))


def cluster_slope(spark, sf_dir: str) -> DataFrame:
    """Slope of forward returns on signals, its error clustered by name and date."""
    out = inference.clustered_slope(market.panel(spark, sf_dir), "forward_return", "signal", "ticker", "signal_date")
    return out.select("n", F.round("slope", 8).alias("slope"), F.round("se", 8).alias("se"), F.round("t", 5).alias("t"))


def floor_quintiles(spark, sf_dir: str) -> DataFrame:
    """Mean return by fifth of the descending signal: min(5, floor((rank - 1) * 5 / n) + 1)."""
    date = Window.partitionBy(*DATE)
    rank, n = F.row_number().over(date.orderBy(F.desc("signal"), "ticker")), F.count("*").over(date)
    rows = market.panel(spark, sf_dir).withColumn("fifth", F.least(F.lit(5), F.floor((rank - 1) * 5 / n) + 1))
    return rows.groupBy("signal_date", "fifth").agg(F.count("*").alias("n"), F.round(F.avg("forward_return"), 8).alias("mean"))


def top_fifth(spark, sf_dir: str) -> DataFrame:
    """The ceil(n / 5) names of the largest signal and what they earned over the date's mean."""
    date = Window.partitionBy(*DATE)
    rows = market.panel(spark, sf_dir).withColumns({"r": F.row_number().over(date.orderBy(F.desc("signal"), "ticker")), "n": F.count("*").over(date)})
    top = F.avg(F.when(F.col("r") <= F.ceil(F.col("n") / 5), F.col("forward_return")))
    return rows.groupBy(*DATE).agg(F.max(F.ceil(F.col("n") / 5)).alias("names"), F.round(top - F.avg("forward_return"), 8).alias("excess"))


def quartiles(spark, sf_dir: str) -> DataFrame:
    """Difference of the outer quarters by rank, from twelve names a date."""
    placed = market.panel(spark, sf_dir).withColumn("q", inference.rank_bucket("signal", DATE, "ticker", 4))
    mean = lambda q: F.avg(F.when(F.col("q") == q, F.col("forward_return")))
    return placed.groupBy(*DATE).agg(F.count("*").alias("n"), F.round(mean(4) - mean(1), 8).alias("spread")).filter("n >= 12")


def pooled(spark, sf_dir: str) -> DataFrame:
    """Each name's sector, those with few names on the date pooled."""
    rows = signals(spark, sf_dir).join(securities(spark, sf_dir).select("ticker", "sector"), "ticker")
    few = F.count("*").over(Window.partitionBy("signal_date", "sector")) < RARE_SECTOR
    return rows.select("signal_date", "ticker", F.when(few, "OTHER_RARE_OR_UNKNOWN").otherwise(F.col("sector")).alias("sector"))


def horizons(spark, sf_dir: str) -> DataFrame:
    """Forward returns over all horizons: a row for each, with whether the name dropped out.

    An entry's exits are exploded and met in one as-of pass, whatever their number.
    """
    entry = market.entry_prices(spark, sf_dir).filter("close is not null").select("signal_date", "ticker", F.col("close").alias("entry_close"))
    asked = entry.withColumn("days", F.explode(F.array(*map(F.lit, HORIZONS)))).withColumn("exit_at", F.expr("date_add(signal_date, days)"))
    out = market.asof_join(asked, prices(spark, sf_dir), ["ticker"], "exit_at", "price_date", ["close"], within_days=STALE_DAYS)
    return out.select("signal_date", "ticker", "days", F.round(F.col("close") / F.col("entry_close") - 1, 6).alias("forward_return"), F.col("close").isNull().alias("attrited"))


def attrition(spark, sf_dir: str) -> DataFrame:
    """Share of names without an exit price by horizon, and by date over all."""
    rows = horizons(spark, sf_dir)
    sums = rows.groupBy("days").agg(F.count("*").alias("names"), F.count_if("attrited").alias("lost"))
    return sums.select("days", "names", "lost", F.round(F.col("lost") / F.col("names"), 8).alias("share"))


def measure_deltas(spark, sf_dir: str) -> DataFrame:
    """Per date, each horizon's mean return in a column, and the differences from the first."""
    wide = horizons(spark, sf_dir).filter("not attrited").groupBy(*DATE).pivot("days", list(HORIZONS)).agg(F.avg("forward_return"))
    first = str(HORIZONS[0])
    return wide.select("signal_date", *(F.round(str(h), 8).alias(f"mean_{h}") for h in HORIZONS), *(F.round(F.col(str(h)) - F.col(first), 8).alias(f"delta_{h}") for h in HORIZONS[1:]))


def measure_correlations(spark, sf_dir: str) -> DataFrame:
    """Rank correlations of the signal with returns over each horizon by market; null below ten pairs."""
    rows = horizons(spark, sf_dir).filter("not attrited").join(signals(spark, sf_dir), ["signal_date", "ticker"]).join(securities(spark, sf_dir).select("ticker", "market"), "ticker")
    by = ["market", "days"]
    ranked = rows.withColumns({"x": average_rank("signal", by), "y": average_rank("forward_return", by)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.round(rank_correlation("x", "y", 10), 6).alias("spearman"))


def together(spark, sf_dir: str) -> DataFrame:
    """How many names have a return over both of two horizons."""
    rows = horizons(spark, sf_dir).filter("not attrited").groupBy("signal_date", "ticker").agg(F.array_sort(F.collect_list("days")).alias("d"))
    pairs = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 1, F.size("d")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("names"))


def compounded_years(spark, sf_dir: str) -> DataFrame:
    """Each name's compounded change by year; null values are skipped."""
    rows = changes(spark, sf_dir).groupBy("ticker", F.year("price_date").alias("year"))
    return rows.agg(F.count("*").alias("n"), F.round(F.exp(F.sum(F.log1p("change"))) - 1, 6).alias("compounded"))


def cycle_phases(spark, sf_dir: str) -> DataFrame:
    """The phase of each name's last year by its change against the quartiles of all its years: trough, middle or peak."""
    years = compounded_years(spark, sf_dir)
    quartile = years.groupBy("ticker").agg(F.percentile("compounded", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.max_by("compounded", "year").alias("last"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    phase = F.when(F.col("last") <= low, "TROUGH").when(F.col("last") >= high, "PEAK").otherwise("MID")
    return quartile.select("ticker", *(F.round(c, 6).alias(n) for c, n in ((low, "low"), (high, "high"), (F.col("last"), "last"))), phase.alias("phase"))


def paired_differences(spark, sf_dir: str) -> DataFrame:
    """Mean difference of yearly from quarterly returns by market over dates, with an error that allows for autocorrelation."""
    rows = horizons(spark, sf_dir).filter("not attrited and days in (77, 365)").join(securities(spark, sf_dir).select("ticker", "market"), "ticker")
    wide = rows.groupBy("market", *DATE).pivot("days", [77, 365]).agg(F.avg("forward_return"))
    paired = wide.filter("`77` is not null and `365` is not null").select("market", "signal_date", F.round(F.col("365") - F.col("77"), 9).alias("delta"))
    out = inference.newey_west(paired, "delta", "signal_date", ["market"], 1)
    return out.select("market", "n", *(F.round(c, 6).alias(c) for c in ("mean", "se")), F.round("t", 4).alias("t"))


QUERIES = {
    "hashed_tie_q5_q1": hashed_ties,
    "tie_diagnostics": ties,
    "singleton_excluded_ic": neutral_without_singletons,
    "residualize_gram_schmidt": two_controls,
    "rank_normal_score": normal_scores,
    "residualize_multi_dummy": with_dummies,
    "block_bootstrap_ci": bootstrap,
    "two_way_cluster_slope": cluster_slope,
    "quintile_floor_rule": floor_quintiles,
    "top_fifth_excess": top_fifth,
    "quartile_spread": quartiles,
    "pooled_sector": pooled,
    "forward_return_horizons": horizons,
    "attrition_flags": attrition,
    "pivot_measure_delta": measure_deltas,
    "measure_correlations": measure_correlations,
    "coobservation_matrix": together,
    "compound_changes": compounded_years,
    "cycle_phase": cycle_phases,
    "paired_differences": paired_differences,
}

_COARSE = market.PANEL_SQL + ",\nco AS (SELECT * REPLACE (round(signal, 1) AS signal) FROM panel)"
_CONTROLLED = market.PANEL_SQL + """,
ct AS (SELECT panel.*, ln(e.entry_close) AS log_price, ln(shares) AS log_shares FROM panel JOIN e USING (signal_date, ticker) JOIN securities USING (ticker))"""
_HORIZONS = market.RETURNS_SQL + """,
hz AS (SELECT a.signal_date, a.ticker, a.days, CASE WHEN a.exit_at - p.price_date <= 10 THEN round(p.close / a.entry_close - 1, 6) END AS forward_return
  FROM (SELECT signal_date, ticker, entry_close, days::INTEGER AS days, signal_date + days::INTEGER AS exit_at FROM e, unnest([77, 182, 365, 730]) AS u(days) WHERE entry_close IS NOT NULL) a
  ASOF LEFT JOIN prices p ON a.ticker = p.ticker AND a.exit_at >= p.price_date)"""
_YEARS = with_views("prices") + ",\n" + market.CHANGES_SQL + """,
yr AS (SELECT ticker, year(price_date)::INTEGER AS year, count(*) AS n, round(exp(sum(ln(1 + change))) - 1, 6) AS compounded FROM changes GROUP BY 1, 2)"""


def _sql_horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def _sql_probit(p: str) -> str:
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{_sql_horner(inference.PROBIT_C, x)} / {_sql_horner(inference.PROBIT_D, x)}"
    centre = f"{_sql_horner(inference.PROBIT_A, f'{q} * {q}')} * {q} / {_sql_horner(inference.PROBIT_B, f'{q} * {q}')}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -({tail(high)}) ELSE {centre} END"


def _sql_share(value: str) -> str:
    return f"greatest(1e-6, least(1 - 1e-6, (rank() OVER (PARTITION BY signal_date ORDER BY {value}) + (count(*) OVER (PARTITION BY signal_date, {value}) - 1) / 2) / count(*) OVER (PARTITION BY signal_date)))"


ORACLE_SQL = {
    "hashed_tie_q5_q1": _COARSE + """,
s AS (SELECT *, sim, count(*) OVER (PARTITION BY signal_date, sim) AS n, row_number() OVER (PARTITION BY signal_date, sim ORDER BY signal, sha256('ties-v1|' || sim || '|' || ticker)) AS r FROM co, range(0, 1000) AS g(sim)),
d AS (SELECT signal_date, sim, max(CASE WHEN n >= 5 THEN greatest(1, n // 5) END) AS t, avg(forward_return) FILTER (WHERE n >= 5 AND r > n - greatest(1, n // 5)) - avg(forward_return) FILTER (WHERE n >= 5 AND r <= greatest(1, n // 5)) AS d FROM s GROUP BY 1, 2)
SELECT signal_date, coalesce(max(t), 0) AS tail_n, round(avg(d), 8) AS spread FROM d GROUP BY 1""",
    "tie_diagnostics": _COARSE + """,
c AS (SELECT signal_date, signal, count(*) AS c FROM co GROUP BY 1, 2),
o AS (SELECT signal_date, list(signal ORDER BY signal) AS l, count(*) AS n FROM co GROUP BY 1)
SELECT o.signal_date, count(*) AS distinct_signals, round(max(c) / max(n), 8) AS largest_share, max(c) FILTER (WHERE signal = l[n - greatest(1, n // 5) + 1]) AS top_ties,
  max(c) FILTER (WHERE signal = l[greatest(1, n // 5)]) AS bottom_ties FROM o JOIN c USING (signal_date) GROUP BY 1""",
    "singleton_excluded_ic": market.PANEL_SQL + """,
c AS (SELECT *, count(*) OVER w AS c, round(signal - avg(signal) OVER w, 9) AS s, round(forward_return - avg(forward_return) OVER w, 9) AS f FROM panel WINDOW w AS (PARTITION BY signal_date, sector)),
r AS (SELECT *, rank() OVER (PARTITION BY signal_date ORDER BY s) + (count(*) OVER (PARTITION BY signal_date, s) - 1) / 2 AS x, rank() OVER (PARTITION BY signal_date ORDER BY f) + (count(*) OVER (PARTITION BY signal_date, f) - 1) / 2 AS y FROM c WHERE c >= 2),
i AS (SELECT signal_date, count(*) AS n, count(DISTINCT sector) AS sectors, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS ic FROM r GROUP BY 1),
g AS (SELECT signal_date, count(*) FILTER (WHERE c < 2) AS singletons FROM c GROUP BY 1)
SELECT signal_date, singletons, coalesce(n, 0) AS n, coalesce(sectors, 0) AS sectors, ic FROM g LEFT JOIN i USING (signal_date)""",
    "residualize_gram_schmidt": _CONTROLLED + """,
a AS (SELECT signal_date, ticker, signal - avg(signal) OVER w AS y, log_price - avg(log_price) OVER w AS u, log_shares - avg(log_shares) OVER w AS v FROM ct WINDOW w AS (PARTITION BY signal_date)),
b AS (SELECT signal_date, ticker, y - coalesce(CASE WHEN sum(u * u) OVER w > 1e-20 THEN sum(y * u) OVER w / sum(u * u) OVER w END, 0) * u AS y, v - coalesce(CASE WHEN sum(u * u) OVER w > 1e-20 THEN sum(v * u) OVER w / sum(u * u) OVER w END, 0) * u AS v FROM a WINDOW w AS (PARTITION BY signal_date))
SELECT signal_date, ticker, round(y - coalesce(CASE WHEN sum(v * v) OVER w > 1e-20 THEN sum(y * v) OVER w / sum(v * v) OVER w END, 0) * v, 6) AS residual FROM b WINDOW w AS (PARTITION BY signal_date)""",
    "rank_normal_score": with_views("prices", "dates", "signals") + f""",
p AS (SELECT signal_date, ticker, count(*) OVER (PARTITION BY signal_date) AS n, {_sql_share('signal')} AS p FROM signals)
SELECT signal_date, ticker, CASE WHEN n >= 2 THEN round({_sql_probit('p')}, 6) END AS score FROM p""",
    "residualize_multi_dummy": _CONTROLLED + f""",
p AS (SELECT signal_date, ticker, sector, count(*) OVER (PARTITION BY signal_date) AS n, {_sql_share('signal')} AS p, {_sql_share('log_price')} AS q FROM ct),
z AS (SELECT signal_date, ticker, sector, n, round({_sql_probit('p')}, 9) AS y, round({_sql_probit('q')}, 9) AS x FROM p),
d AS (SELECT signal_date, ticker, n, y - avg(y) OVER w AS y, x - avg(x) OVER w AS x FROM z WINDOW w AS (PARTITION BY signal_date, sector))
SELECT signal_date, ticker, CASE WHEN n > 3 THEN round(y - coalesce(CASE WHEN sum(x * x) OVER w > 1e-20 THEN sum(y * x) OVER w / sum(x * x) OVER w END, 0) * x, 6) END AS residual FROM d WINDOW w AS (PARTITION BY signal_date)""",
    "block_bootstrap_ci": with_views("securities", "prices") + ",\n" + market.CHANGES_SQL + """,
m AS (SELECT market, price_date, round(avg(change), 6) AS change FROM changes JOIN securities USING (ticker) GROUP BY 1, 2),
v AS (SELECT market, date_trunc('week', price_date)::DATE AS week, round(avg(change), 9) AS v FROM m GROUP BY 1, 2),
x AS (SELECT market, v, row_number() OVER (PARTITION BY market ORDER BY week) - 1 AS spot FROM v),
n AS (SELECT market, count(*) AS n, avg(v) AS mean, least(4, count(*)) AS b FROM x GROUP BY 1),
d AS (SELECT market, n, mean, r, (('0x' || substr(sha256('boot-v1|' || r || '|' || k), 1, 13))::BIGINT % (n - b + 1)) + o AS spot FROM n, range(0, 10000) AS g(r), LATERAL (SELECT unnest(range(0, ceil(n / b)::BIGINT)) AS k), range(0, 4) AS h(o) WHERE o < b AND k * b + o < n),
a AS (SELECT market, n, mean, r, avg(v) AS m FROM d JOIN x USING (market, spot) GROUP BY 1, 2, 3, 4)
SELECT market, n, round(mean, 7) AS mean, round(quantile_cont(m, 0.025), 7) AS low, round(quantile_cont(m, 0.975), 7) AS high FROM a GROUP BY 1, 2, mean""",
    "two_way_cluster_slope": market.PANEL_SQL + """,
f AS (SELECT count(*) AS n, avg(signal) AS mx, avg(forward_return) AS my, covar_pop(forward_return, signal) / var_pop(signal) AS slope, var_pop(signal) AS vx FROM panel),
u AS (SELECT ticker, signal_date, (signal - mx) * (forward_return - my - slope * (signal - mx)) AS u FROM panel, f),
m AS (SELECT (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM u GROUP BY ticker)) + (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM u GROUP BY signal_date)) - (SELECT sum(u * u) FROM u) AS m)
SELECT n, round(slope, 8) AS slope, round(sqrt(greatest(0, m)) / (n * vx), 8) AS se, round(slope / nullif(sqrt(greatest(0, m)) / (n * vx), 0), 5) AS t FROM f, m""",
    "quintile_floor_rule": market.PANEL_SQL + """,
r AS (SELECT signal_date, forward_return, least(5, floor((row_number() OVER (PARTITION BY signal_date ORDER BY signal DESC, ticker) - 1) * 5 / count(*) OVER (PARTITION BY signal_date)) + 1)::BIGINT AS fifth FROM panel)
SELECT signal_date, fifth, count(*) AS n, round(avg(forward_return), 8) AS mean FROM r GROUP BY 1, 2""",
    "top_fifth_excess": market.PANEL_SQL + """,
r AS (SELECT signal_date, forward_return, row_number() OVER (PARTITION BY signal_date ORDER BY signal DESC, ticker) AS r, ceil(count(*) OVER (PARTITION BY signal_date) / 5)::BIGINT AS k FROM panel)
SELECT signal_date, max(k) AS names, round(avg(forward_return) FILTER (WHERE r <= k) - avg(forward_return), 8) AS excess FROM r GROUP BY 1""",
    "quartile_spread": market.PANEL_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY signal, ticker) AS r, count(*) OVER (PARTITION BY signal_date) AS n FROM panel),
qr AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, ceil((r - 1) * 4 / (n - 1))) ELSE 1 END AS q FROM r)
SELECT signal_date, count(*) AS n, round(avg(forward_return) FILTER (WHERE q = 4) - avg(forward_return) FILTER (WHERE q = 1), 8) AS spread FROM qr GROUP BY 1 HAVING count(*) >= 12""",
    "pooled_sector": with_views("securities", "prices", "dates", "signals") + """
SELECT signal_date, ticker, CASE WHEN count(*) OVER (PARTITION BY signal_date, sector) < 5 THEN 'OTHER_RARE_OR_UNKNOWN' ELSE sector END AS sector FROM signals JOIN securities USING (ticker)""",
    "forward_return_horizons": _HORIZONS + "\nSELECT *, forward_return IS NULL AS attrited FROM hz",
    "attrition_flags": _HORIZONS + """
SELECT days, count(*) AS names, count(*) FILTER (WHERE forward_return IS NULL) AS lost, round(count(*) FILTER (WHERE forward_return IS NULL) / count(*), 8) AS share FROM hz GROUP BY 1""",
    "pivot_measure_delta": _HORIZONS + """,
w AS (SELECT signal_date, avg(forward_return) FILTER (WHERE days = 77) AS a, avg(forward_return) FILTER (WHERE days = 182) AS b, avg(forward_return) FILTER (WHERE days = 365) AS c, avg(forward_return) FILTER (WHERE days = 730) AS d FROM hz WHERE forward_return IS NOT NULL GROUP BY 1)
SELECT signal_date, round(a, 8) AS mean_77, round(b, 8) AS mean_182, round(c, 8) AS mean_365, round(d, 8) AS mean_730, round(b - a, 8) AS delta_182, round(c - a, 8) AS delta_365, round(d - a, 8) AS delta_730 FROM w""",
    "measure_correlations": _HORIZONS + """,
j AS (SELECT market, days, signal, hz.forward_return AS f FROM hz JOIN signals USING (signal_date, ticker) JOIN securities USING (ticker) WHERE hz.forward_return IS NOT NULL),
r AS (SELECT market, days, rank() OVER (PARTITION BY market, days ORDER BY signal) + (count(*) OVER (PARTITION BY market, days, signal) - 1) / 2 AS x, rank() OVER (PARTITION BY market, days ORDER BY f) + (count(*) OVER (PARTITION BY market, days, f) - 1) / 2 AS y FROM j)
SELECT market, days, count(*) AS n, CASE WHEN count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS spearman FROM r GROUP BY 1, 2""",
    "coobservation_matrix": _HORIZONS + """,
k AS (SELECT signal_date, ticker, days FROM hz WHERE forward_return IS NOT NULL)
SELECT x.days AS a, y.days AS b, count(*) AS names FROM k x JOIN k y ON x.signal_date = y.signal_date AND x.ticker = y.ticker AND x.days <= y.days GROUP BY 1, 2""",
    "compound_changes": _YEARS + "\nSELECT * FROM yr",
    "cycle_phase": _YEARS + """,
q AS (SELECT ticker, quantile_cont(compounded, 0.25) AS low, quantile_cont(compounded, 0.75) AS high, arg_max(compounded, year) AS last FROM yr GROUP BY 1)
SELECT ticker, round(low, 6) AS low, round(high, 6) AS high, round(last, 6) AS last, CASE WHEN last <= low THEN 'TROUGH' WHEN last >= high THEN 'PEAK' ELSE 'MID' END AS phase FROM q""",
    "paired_differences": _HORIZONS + """,
w AS (SELECT market, signal_date, avg(hz.forward_return) FILTER (WHERE days = 77) AS a, avg(hz.forward_return) FILTER (WHERE days = 365) AS c FROM hz JOIN securities USING (ticker) WHERE hz.forward_return IS NOT NULL GROUP BY 1, 2),
dl AS (SELECT market, signal_date, round(c - a, 9) AS delta FROM w WHERE a IS NOT NULL AND c IS NOT NULL),
dm AS (SELECT market, signal_date, avg(delta) OVER g AS m, delta - avg(delta) OVER g AS e, count(*) OVER g AS n FROM dl WINDOW g AS (PARTITION BY market)),
l AS (SELECT market, m, n, e * e + 2 * greatest(0, 1 - 1 / (least(1, n - 1) + 1)) * coalesce(e * lag(e, 1) OVER o, 0) AS v FROM dm WINDOW o AS (PARTITION BY market ORDER BY signal_date)),
s AS (SELECT market, max(n) AS n, max(m) AS mean, sqrt(greatest(0, sum(v))) / max(n) AS se FROM l GROUP BY 1)
SELECT market, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / nullif(se, 0), 4) AS t FROM s""",
}
