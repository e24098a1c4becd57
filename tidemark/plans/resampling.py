"""Permutations, bootstraps and regressions of signals with forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import average_rank, rank_correlation
from tidemark.operators.regression import panel_regressions
from tidemark.operators.resampling import bootstrap_correlations, date_bootstrap, permutation_p_values
from tidemark.plans import market, statistics
from tidemark.plans.views import securities
from tidemark.sources.scratch import materialize, release

SAMPLES, SEED = 10_000, "economic-v1"
DATE = statistics.DATE
CONTROLS = ("log_price", "log_shares", "prior")


def _names(spark, sf_dir: str) -> DataFrame:
    """Each name's mean signal, price and forward return."""
    rows = statistics._controlled(spark, sf_dir).groupBy("ticker").agg(*(F.round(F.avg(c), 6).alias(a) for c, a in (("signal", "growth"), ("log_price", "price"), ("forward_return", "result"))))
    return rows.join(securities(spark, sf_dir).select("ticker", "market"), "ticker")


def permutations(spark, sf_dir: str) -> DataFrame:
    """How often chance gives a market's rank correlations of two scores with returns."""
    out = permutation_p_values(_names(spark, sf_dir), ["growth", "price"], "result", ["market"], "ticker", SAMPLES, SEED)
    return out.select("market", "label", "n", F.round("ic", 8).alias("ic"), F.round("p", 8).alias("p"))


def intervals(spark, sf_dir: str) -> DataFrame:
    """Intervals of a market's rank correlations of two scores with returns, and of their difference, over names drawn with replacement."""
    out = bootstrap_correlations(_names(spark, sf_dir), "growth", "price", "result", ["market"], "ticker", SAMPLES, SEED)
    return out.select("market", "label", "valid", *(F.round(c, 6).alias(c) for c in ("low", "high", "positive")))


def by_dates(spark, sf_dir: str) -> DataFrame:
    """Intervals of the mean rank correlation over dates drawn with replacement."""
    ranked = statistics._controlled(spark, sf_dir).withColumns({f"r_{c}": average_rank(c, DATE) for c in ("signal", "log_price", "forward_return")})
    values = ranked.groupBy(*DATE).agg(F.round(rank_correlation("r_signal", "r_forward_return"), 9).alias("growth"), F.round(rank_correlation("r_log_price", "r_forward_return"), 9).alias("price"))
    out = date_bootstrap(values, ["growth", "price"], "signal_date", SAMPLES, SEED)
    return out.select("label", "valid", *(F.round(c, 7).alias(c) for c in ("low", "high", "positive")))


def specifications(spark, sf_dir: str) -> DataFrame:
    """Returns on signals without controls, with each, and with all of price, size and the signal before; controls are ranks within dates, from 0 to 1."""
    rows = statistics._controlled(spark, sf_dir).withColumn("prior", F.lag("signal").over(Window.partitionBy("ticker").orderBy("signal_date")))
    share = lambda c: F.when(F.col(c).isNotNull(), F.round((average_rank(c, [*DATE, "known"]) - 1) / F.greatest(F.count("*").over(Window.partitionBy(*DATE, "known")) - 1, F.lit(1)), 9))
    ranked = rows.withColumn("known", F.lit(True)).withColumns({c: share(c) for c in CONTROLS[:2]})
    ranked = materialize(ranked.withColumn("known", F.col("prior").isNotNull()).withColumn("prior", share("prior")).drop("known"), "ranked")
    specs = {"NONE": [], **{c: [c] for c in CONTROLS}, "ALL": list(CONTROLS)}
    out = panel_regressions(ranked, "forward_return", "signal", specs, "ticker", "signal_date").withColumnRenamed("specification", "controls")
    release(ranked)
    base = out.filter(F.col("controls") == "NONE").first()["coefficient"]
    kept = F.try_divide(F.col("coefficient"), F.lit(base))
    return out.select("controls", "n", "units", "periods", *(F.round(c, 7).alias(a) for a, c in (("coefficient", "coefficient"), ("se", "se"), ("t", "t"), ("retention", kept), ("r_squared", "r_squared"))))


QUERIES = {"permutation_p_values": permutations, "bootstrap_score_intervals": intervals, "date_block_bootstrap": by_dates, "regression_specifications": specifications}

_NAMES = statistics._CONTROLLED + """,
nm AS (SELECT ticker, market, g AS growth, p AS price, f AS result FROM (SELECT ticker, round(avg(signal), 6) AS g, round(avg(log_price), 6) AS p, round(avg(forward_return), 6) AS f FROM ct GROUP BY 1) JOIN securities USING (ticker)),
rk AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY ticker) AS i, count(*) OVER (PARTITION BY market) AS n,
  2 * rank() OVER (PARTITION BY market ORDER BY growth) + count(*) OVER (PARTITION BY market, growth) - 1 AS a,
  2 * rank() OVER (PARTITION BY market ORDER BY price) + count(*) OVER (PARTITION BY market, price) - 1 AS b,
  2 * rank() OVER (PARTITION BY market ORDER BY result) + count(*) OVER (PARTITION BY market, result) - 1 AS y FROM nm)"""
_COEFFICIENTS = """co AS (SELECT s, ('0x' || d[1:12])::BIGINT % 2147483647 AS c0, ('0x' || d[13:24])::BIGINT % 2147483647 AS c1, ('0x' || d[25:36])::BIGINT % 2147483647 AS c2, ('0x' || d[37:48])::BIGINT % 2147483647 AS c3
  FROM (SELECT s, sha256('economic-v1|' || s) AS d FROM range(0, 10000) AS g(s)))"""
_DRAWN = "((((c3 * {x} + c2) % 2147483647) * {x} + c1) % 2147483647 * {x} + c0) % 2147483647"
_BOUNDS = "count(*) AS valid, round(quantile_cont(v, 0.025), {d}) AS low, round(quantile_cont(v, 0.975), {d}) AS high, round(avg((v > 0)::INTEGER), {d}) AS positive"


def _regression_sql(name: str, controls: list[str]) -> str:
    """Controls are taken out one after another, which needs no matrix."""
    columns = ["y", "x", *controls]
    source = {"y": "forward_return", "x": "signal"}
    steps = [f"{name}0 AS (SELECT ticker, signal_date, signal, " + ", ".join(f"{source.get(c, c)} - avg({source.get(c, c)}) OVER (PARTITION BY signal_date) AS {c}" for c in columns) + " FROM sh" + (" WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in controls) if controls else "") + ")"]
    for k, c in enumerate(controls):
        left = ["y", "x", *controls[k + 1:]]
        steps.append(f"{name}{k + 1} AS (SELECT ticker, signal_date, signal, " + ", ".join(f"{v} - {c} * coalesce((SELECT sum({v} * {c}) / nullif(sum({c} * {c}), 0) FROM {name}{k}), 0) AS {v}" for v in left) + f" FROM {name}{k})")
    last = f"{name}{len(controls)}"
    steps.append(f"{name}f AS (SELECT count(*) AS n, count(DISTINCT ticker) AS units, count(DISTINCT signal_date) AS periods, sum(x * y) / sum(x * x) AS b, sum(x * x) AS size, var_pop(signal) * count(*) AS spread FROM {last})")
    steps.append(f"{name}u AS (SELECT ticker, signal_date, x * (y - b * x) AS u FROM {last}, {name}f)")
    explained = "round(1 - size / nullif(spread, 0), 7)" if controls else "0.0"
    steps.append(f"""{name} AS (SELECT '{name if name != "NONE_" else "NONE"}' AS controls, n, units, periods, b, sqrt(greatest(0, (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM {name}u GROUP BY ticker)) + (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM {name}u GROUP BY signal_date)) - (SELECT sum(u * u) FROM {name}u))) / size AS se, {explained} AS r_squared FROM {name}f)""")
    return ",\n".join(steps)


_SPECS = {"NONE_": [], **{c: [c] for c in CONTROLS}, "ALL_": list(CONTROLS)}

ORACLE_SQL = {
    "permutation_p_values": _NAMES + ",\n" + _COEFFICIENTS + """,
dr AS (SELECT market, s, a, b, row_number() OVER (PARTITION BY market, s ORDER BY """ + _DRAWN.format(x="i") + """, i) AS i FROM rk, co),
pm AS (SELECT dr.market, s, sum(dr.a * y)::HUGEINT AS pa, sum(dr.b * y)::HUGEINT AS pb FROM dr JOIN rk ON dr.market = rk.market AND dr.i = rk.i GROUP BY 1, 2),
ob AS (SELECT market, max(n)::HUGEINT AS n, sum(a)::HUGEINT AS sa, sum(b)::HUGEINT AS sb, sum(y)::HUGEINT AS sy, sum(a * y)::HUGEINT AS xa, sum(b * y)::HUGEINT AS xb, corr(a, y) AS ca, corr(b, y) AS cb,
  count(DISTINCT a) > 1 AND count(DISTINCT y) > 1 AS va, count(DISTINCT b) > 1 AND count(DISTINCT y) > 1 AS vb FROM rk GROUP BY 1),
ct2 AS (SELECT market, count(*) FILTER (WHERE abs(n * pa - sa * sy) >= abs(n * xa - sa * sy)) AS ea, count(*) FILTER (WHERE abs(n * pb - sb * sy) >= abs(n * xb - sb * sy)) AS eb FROM pm JOIN ob USING (market) GROUP BY 1)
SELECT market, 'growth' AS label, n::BIGINT AS n, CASE WHEN va THEN round(ca, 8) END AS ic, round((CASE WHEN va THEN ea ELSE 0 END + 1) / 10001, 8) AS p FROM ct2 JOIN ob USING (market)
UNION ALL SELECT market, 'price', n::BIGINT, CASE WHEN vb THEN round(cb, 8) END, round((CASE WHEN vb THEN eb ELSE 0 END + 1) / 10001, 8) FROM ct2 JOIN ob USING (market)""",
    "bootstrap_score_intervals": _NAMES + ",\n" + _COEFFICIENTS + """,
sp AS (SELECT market, s, (""" + _DRAWN.format(x="j") + """) % n + 1 AS i FROM (SELECT market, max(n) AS n FROM rk GROUP BY 1), co, LATERAL (SELECT unnest(range(1, n + 1)) AS j)),
tm AS (SELECT sp.market, s, a, b, y FROM sp JOIN rk ON sp.market = rk.market AND sp.i = rk.i),
ag AS (SELECT market, s, rank() OVER (PARTITION BY market, s ORDER BY a) + (count(*) OVER (PARTITION BY market, s, a) - 1) / 2 AS a, rank() OVER (PARTITION BY market, s ORDER BY b) + (count(*) OVER (PARTITION BY market, s, b) - 1) / 2 AS b,
  rank() OVER (PARTITION BY market, s ORDER BY y) + (count(*) OVER (PARTITION BY market, s, y) - 1) / 2 AS y FROM tm),
ic AS (SELECT market, round(corr(a, y), 12) AS a, round(corr(b, y), 12) AS b FROM ag GROUP BY market, s HAVING count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 AND count(DISTINCT y) > 1),
lb AS (SELECT market, 'growth' AS label, a AS v FROM ic UNION ALL SELECT market, 'price', b FROM ic UNION ALL SELECT market, 'growth_less_price', round(a - b, 12) FROM ic)
SELECT market, label, """ + _BOUNDS.format(d=6) + """ FROM lb GROUP BY 1, 2""",
    "date_block_bootstrap": statistics._CONTROLLED + ",\n" + _COEFFICIENTS + """,
r3 AS (SELECT signal_date, rank() OVER (PARTITION BY signal_date ORDER BY signal) + (count(*) OVER (PARTITION BY signal_date, signal) - 1) / 2 AS a, rank() OVER (PARTITION BY signal_date ORDER BY log_price) + (count(*) OVER (PARTITION BY signal_date, log_price) - 1) / 2 AS b,
  rank() OVER (PARTITION BY signal_date ORDER BY forward_return) + (count(*) OVER (PARTITION BY signal_date, forward_return) - 1) / 2 AS y FROM ct),
dt AS (SELECT row_number() OVER (ORDER BY signal_date) AS i, count(*) OVER () AS n, round(a, 9) AS a, round(b, 9) AS b FROM (SELECT signal_date, corr(a, y) AS a, corr(b, y) AS b FROM r3 GROUP BY 1
  HAVING count(*) >= 5 AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 AND count(DISTINCT y) > 1)),
ms AS (SELECT s, avg(a) AS a, avg(b) AS b FROM (SELECT s, (""" + _DRAWN.format(x="j") + """) % n + 1 AS i FROM co, (SELECT max(n) AS n FROM dt), LATERAL (SELECT unnest(range(1, n + 1)) AS j)) JOIN dt USING (i) GROUP BY 1),
lb AS (SELECT 'growth' AS label, a AS v FROM ms UNION ALL SELECT 'price', b FROM ms UNION ALL SELECT 'growth_less_price', a - b FROM ms)
SELECT label, """ + _BOUNDS.format(d=7) + """ FROM lb GROUP BY 1""",
    "regression_specifications": statistics._CONTROLLED + """,
pr AS (SELECT *, lag(signal) OVER (PARTITION BY ticker ORDER BY signal_date) AS before FROM ct),
sh AS (SELECT ticker, signal_date, signal, forward_return,
""" + ",\n".join(f"  CASE WHEN {c} IS NOT NULL THEN round((rank() OVER (PARTITION BY signal_date, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY signal_date, {c}) - 1) / 2 - 1) / greatest(count({c}) OVER (PARTITION BY signal_date) - 1, 1), 9) END AS {a}" for c, a in (("log_price", "log_price"), ("log_shares", "log_shares"), ("before", "prior"))) + """ FROM pr),
""" + ",\n".join(_regression_sql(name, controls) for name, controls in _SPECS.items()) + """,
al AS (""" + " UNION ALL ".join(f"SELECT * FROM {name}" for name in _SPECS) + """)
SELECT rtrim(controls, '_') AS controls, n, units, periods, round(b, 7) AS coefficient, round(se, 7) AS se, round(b / nullif(se, 0), 7) AS t, round(b / nullif((SELECT b FROM al WHERE controls = 'NONE'), 0), 7) AS retention, r_squared FROM al""",
}
