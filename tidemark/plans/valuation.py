"""Valuation kernels, grids, routing and reference classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import average_rank
from tidemark.plans.companies import WIDE_SQL, fundamentals
from tidemark.plans.views import prices, securities, with_views
from tidemark.sources.tables import table

#: Cost of equity, payout, terminal growth, fade and years of residual income.
KE, PAYOUT, RIM_GROWTH, FADE, RIM_YEARS = 0.10, 0.40, 0.02, 0.25, 5
#: Odds of success and years to launch by phase 1, 2, 3 and approved.
SUCCESS, TO_LAUNCH = (0.138, 0.210, 0.590, 1.0), (7, 5, 2, 0)
RNPV_RATE, YEARLY_COST = 0.12, 0.01
HAIRCUT = 0.20
GROWTHS, MARGINS = (-0.05, 0.0, 0.05, 0.10, 0.15), (0.05, 0.10, 0.15, 0.20, 0.25)
WACC, GRID_YEARS, STABLE, TAX, REINVESTED = 0.105, 5, 0.02, 0.24, 0.01
#: Members that a reference class must have.
CLASS_LEAST = 20


def _margin() -> Column:
    return F.greatest(F.lit(-0.2), F.least(F.lit(0.35), F.col("ebit") / F.col("revenue") / 4))


def metrics(spark, sf_dir: str) -> DataFrame:
    """Ratios of an issuer's year; a ratio needs both sides above zero, a sum all of its parts."""
    ratio = lambda a, b: F.round(F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b)), 6)
    return fundamentals(spark, sf_dir).select(
        "issuer", "fiscal_year", ratio("ebit", "revenue").alias("ebit_yield"), ratio("cash", "revenue").alias("cash_yield"), ratio("capex", "ebit").alias("capex_share"),
        F.round(F.col("ebit") * (1 - TAX) - F.col("capex"), 4).alias("fcf"),
    )


def cagr(spark, sf_dir: str) -> DataFrame:
    """Yearly growth of revenue from an issuer's first year with revenue to its last; null with one year."""
    rows = fundamentals(spark, sf_dir).filter("revenue > 0").groupBy("issuer").agg(
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.min_by("revenue", "fiscal_year").alias("a"), F.max_by("revenue", "fiscal_year").alias("b")
    )
    span = F.col("last_year") - F.col("first_year")
    return rows.select("issuer", "first_year", "last_year", F.when(span > 0, F.round(F.pow(F.col("b") / F.col("a"), 1 / F.when(span > 0, span)) - 1, 6)).alias("cagr"))


#: Methods by archetype, in the order of the ladder, and what each needs.
METHODS = {
    "FINANCE": ("RIM", ("ebit", "revenue")), "HOLDING": ("SOTP", ("capex", "cash")), "PRE_REVENUE": ("RNPV", ("cash",)), "PIPELINE": ("RNPV", ("cash", "revenue")), "ASSET": ("NAV", ("capex", "cash")),
    "CYCLICAL": ("NORMALIZED_FCFF", ("capex", "ebit", "revenue")), "LOSS": ("SCENARIO_DCF", ("cash", "ebit", "revenue")), "GENERAL": ("FCFF", ("capex", "cash", "ebit", "revenue")),
}


def archetypes(spark, sf_dir: str) -> DataFrame:
    """The first archetype that fits: finance, holding, pipelines, assets, cycles, lasting losses, or general; its method and the inputs that it lacks.

    Nothing here depends on a price. Hints and sectors come from the issuer: a
    loss is operating income below capital expenditure, lasting if two years running.
    """
    sector = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issuer"), F.col("c_mktsegment").alias("sector"))
    order = Window.partitionBy("issuer").orderBy("fiscal_year")
    loss = F.coalesce(F.col("ebit") < F.col("capex"), F.lit(False))
    rows = fundamentals(spark, sf_dir).join(sector, "issuer").withColumn("loss", loss)
    rows = rows.withColumn("lasting", F.col("loss") & F.coalesce(F.lag("loss").over(order), F.lit(False)))
    thin = F.coalesce(F.col("revenue") / (F.col("revenue") + F.col("cash")) < 0.25, F.lit(True))
    research = (F.col("sector") == "HOUSEHOLD") & F.col("lasting")
    ladder = (
        ("FINANCE", F.col("issuer") % 17 == 0), ("HOLDING", F.col("issuer") % 19 == 0), ("PRE_REVENUE", research & thin), ("PIPELINE", research), ("ASSET", F.col("sector") == "BUILDING"),
        ("CYCLICAL", F.col("sector").isin("AUTOMOBILE", "MACHINERY")), ("LOSS", F.col("lasting")),
    )
    kind, method, needs = F.lit("GENERAL"), F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, fits in reversed(ladder):
        kind = F.when(fits, name).otherwise(kind)
    for name, (engine, inputs) in METHODS.items():
        method, needs = F.when(F.col("archetype") == name, engine).otherwise(method), F.when(F.col("archetype") == name, F.array(*map(F.lit, inputs))).otherwise(needs)
    known = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in ("capex", "cash", "ebit", "revenue"))))
    missing = F.array_join(F.array_except(needs, known), ",")
    return rows.withColumn("archetype", kind).select("issuer", "fiscal_year", "archetype", method.alias("method"), missing.alias("missing"), F.when(missing == "", "ELIGIBLE").otherwise("INSUFFICIENT_DATA").alias("status"))


def residual_income(spark, sf_dir: str) -> DataFrame:
    """Book value and the present value of residual income, with a return that fades to near the cost of equity."""
    base = fundamentals(spark, sf_dir).filter("revenue > 0 and ebit is not null").withColumns({"book": F.col("revenue") / 2, "roe": _margin()})
    terminal = KE + FADE * (F.col("roe") - KE)
    start = F.struct(F.col("book").alias("book"), F.lit(0.0).alias("pv"))

    def year(acc, t):
        roe = F.col("roe") + (terminal - F.col("roe")) * (t - 1) / (RIM_YEARS - 1)
        return F.struct((acc["book"] * (1 + roe * (1 - PAYOUT))).alias("book"), (acc["pv"] + acc["book"] * (roe - KE) / F.pow(F.lit(1 + KE), t)).alias("pv"))

    run = base.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.lit(RIM_YEARS)), start, year))
    tail = F.col("r.book") * (1 + RIM_GROWTH) * (terminal - KE) / (KE - RIM_GROWTH) / F.pow(F.lit(1 + KE), F.lit(RIM_YEARS))
    return run.select("issuer", "fiscal_year", F.round("book", 4).alias("book"), F.round(F.col("book") + F.col("r.pv") + tail, 2).alias("value"))


def pipeline_value(spark, sf_dir: str) -> DataFrame:
    """Each brand's assets at their odds of success, discounted, less yearly costs until launch."""
    phase = F.col("p_size") % 4
    odds, years = F.lit(SUCCESS[3]), F.lit(TO_LAUNCH[3])
    for k in range(3):
        odds, years = F.when(phase == k, F.lit(SUCCESS[k])).otherwise(odds), F.when(phase == k, F.lit(TO_LAUNCH[k])).otherwise(years)
    assets = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("launch"), odds.alias("odds"), years.alias("years"))
    costs = F.when(F.col("years") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("years", F.lit(1))), F.lit(0.0), lambda a, t: a + F.col("launch") * YEARLY_COST / F.pow(F.lit(1 + RNPV_RATE), t))).otherwise(0.0)
    value = F.col("launch") * F.col("odds") / F.pow(F.lit(1 + RNPV_RATE), F.col("years")) - costs
    return assets.groupBy("p_brand").agg(F.count("*").alias("assets"), F.round(F.sum(value), 4).alias("value"))


def net_assets(spark, sf_dir: str) -> DataFrame:
    """Each market's holdings at their last price, by share owned and after a haircut."""
    last = prices(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "price_date").alias("close"))
    owned = 0.3 + 0.05 * (F.col("shares") % 10)
    rows = last.join(securities(spark, sf_dir), "ticker").withColumn("worth", F.col("close") * F.col("shares") * owned * (1 - HAIRCUT))
    return rows.groupBy("market").agg(F.count("*").alias("holdings"), F.round(F.sum("worth"), 2).alias("nav"))


def implied_surface(spark, sf_dir: str) -> DataFrame:
    """The growth and margin of a grid whose value is nearest to three times the issuer's cash.

    The grid is an array of constants inside one expression, so that a row stays one row.
    """
    base = fundamentals(spark, sf_dir).filter("revenue > 0 and cash > 0").withColumn("target", 3 * F.col("cash"))

    def unit(g: float, m: float) -> float:
        """Value of one of revenue; the same for every issuer."""
        flow = [(1 + g) ** t * (m * (1 - TAX) - REINVESTED) for t in range(1, GRID_YEARS + 1)]
        return sum(f / (1 + WACC) ** t for t, f in enumerate(flow, 1)) + flow[-1] * (1 + STABLE) / (WACC - STABLE) / (1 + WACC) ** GRID_YEARS

    points = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(m).alias("m"), F.lit(unit(g, m)).alias("u")) for g in GROWTHS for m in MARGINS))
    missed = F.transform(points, lambda x: F.struct(F.round(F.abs(F.col("revenue") * x["u"] / F.col("target") - 1), 9).alias("error"), x["g"].alias("g"), x["m"].alias("m")))
    near = base.withColumn("x", F.array_min(missed))
    return near.select("issuer", "fiscal_year", F.col("x.g").alias("growth"), F.col("x.m").alias("margin"), F.round("x.error", 6).alias("error"))


def weighted_median(spark, sf_dir: str) -> DataFrame:
    """Each part's least price that at least half of the quantity was sold at or below."""
    by_price = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_extendedprice").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("w"))
    part = Window.partitionBy("l_partkey")
    run = by_price.withColumns({"c": F.sum("w").over(part.orderBy("l_extendedprice")), "t": F.sum("w").over(part)})
    return run.filter(2 * F.col("c") >= F.col("t")).groupBy("l_partkey").agg(F.min("l_extendedprice").alias("median"))


def reference_class(spark, sf_dir: str) -> DataFrame:
    """A customer's balance among its nation and segment, its nation if those are few, or its region: 100 (average rank - 1) / (n - 1), 50 if alone."""
    places = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    levels = {"NATION_SEGMENT": ["n_regionkey", "c_nationkey", "c_mktsegment"], "NATION": ["n_regionkey", "c_nationkey"], "REGION": ["n_regionkey"]}
    level, size, value = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")
    for name, keys in levels.items():
        n = F.count("*").over(Window.partitionBy(*keys))
        share = F.when(n > 1, 100 * (average_rank("c_acctbal", keys) - 1) / F.when(n > 1, n - 1)).otherwise(50.0)
        rows = rows.withColumns({f"_n{name}": n, f"_p{name}": share})
    for name in reversed(levels):
        enough = F.col(f"_n{name}") >= CLASS_LEAST
        level, size, value = (F.when(enough, now).otherwise(before) for now, before in ((F.lit(name), level), (F.col(f"_n{name}"), size), (F.col(f"_p{name}"), value)))
    return rows.select("c_custkey", level.alias("class"), size.alias("members"), F.round(value, 6).alias("percentile"))


def trailing_year(spark, sf_dir: str) -> DataFrame:
    """Revenue of the twelve months to June: the year before, plus this year's half, less that year's half; null where one is unknown."""
    day = F.to_date("o_orderdate")
    half = F.month(day) <= 6
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("issuer"), F.year(day).alias("year")).agg(F.sum(amount).alias("full"), F.sum(F.when(half, amount)).alias("half"))
    order = Window.partitionBy("issuer").orderBy("year")
    before = F.lag("year").over(order) == F.col("year") - 1
    joined = years.withColumns({"_full": F.when(before, F.lag("full").over(order)), "_half": F.when(before, F.lag("half").over(order))})
    return joined.select("issuer", "year", (F.col("_full") + F.col("half") - F.col("_half")).cast("double").alias("ttm"))


QUERIES = {
    "derived_metrics": metrics,
    "revenue_cagr": cagr,
    "archetype_ladder": archetypes,
    "rim_value": residual_income,
    "rnpv_value": pipeline_value,
    "nav_value": net_assets,
    "reverse_dcf_surface": implied_surface,
    "weighted_quantile": weighted_median,
    "hierarchical_percentile": reference_class,
    "ttm_flows": trailing_year,
}

_RIM_STEPS = "".join(
    f""",
s{t} AS (SELECT *, b{t - 1} * (1 + (roe + (rt - roe) * {t - 1} / 4) * 0.6) AS b{t}, pv{t - 1} + b{t - 1} * (roe + (rt - roe) * {t - 1} / 4 - 0.1) / pow(1.1, {t}) AS pv{t} FROM s{t - 1})"""
    for t in range(1, RIM_YEARS + 1)
)

ORACLE_SQL = {
    "derived_metrics": WIDE_SQL + """
SELECT issuer, fiscal_year, round(CASE WHEN ebit > 0 AND revenue > 0 THEN ebit / revenue END, 6) AS ebit_yield, round(CASE WHEN cash > 0 AND revenue > 0 THEN cash / revenue END, 6) AS cash_yield,
  round(CASE WHEN capex > 0 AND ebit > 0 THEN capex / ebit END, 6) AS capex_share, round(ebit * 0.76::DOUBLE - capex, 4) AS fcf FROM wide""",
    "revenue_cagr": WIDE_SQL + """,
g AS (SELECT issuer, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, arg_min(revenue, fiscal_year) AS a, arg_max(revenue, fiscal_year) AS b FROM wide WHERE revenue > 0 GROUP BY 1)
SELECT issuer, first_year, last_year, CASE WHEN last_year > first_year THEN round(pow(b / a, 1.0::DOUBLE / (last_year - first_year)) - 1, 6) END AS cagr FROM g""",
    "archetype_ladder": WIDE_SQL + """,
l AS (SELECT wide.*, c_mktsegment AS sector, coalesce(ebit < capex, false) AS loss FROM wide JOIN customer ON issuer = c_custkey),
p AS (SELECT *, loss AND coalesce(lag(loss) OVER (PARTITION BY issuer ORDER BY fiscal_year), false) AS lasting, coalesce(revenue / (revenue + cash) < 0.25, true) AS thin FROM l),
a AS (SELECT *, CASE WHEN issuer % 17 = 0 THEN 'FINANCE' WHEN issuer % 19 = 0 THEN 'HOLDING' WHEN sector = 'HOUSEHOLD' AND lasting AND thin THEN 'PRE_REVENUE' WHEN sector = 'HOUSEHOLD' AND lasting THEN 'PIPELINE' WHEN sector = 'BUILDING' THEN 'ASSET'
  WHEN sector IN ('AUTOMOBILE', 'MACHINERY') THEN 'CYCLICAL' WHEN lasting THEN 'LOSS' ELSE 'GENERAL' END AS archetype FROM p),
m AS (SELECT *, concat_ws(',', CASE WHEN capex IS NULL AND archetype IN ('HOLDING', 'ASSET', 'CYCLICAL', 'GENERAL') THEN 'capex' END, CASE WHEN cash IS NULL AND archetype NOT IN ('FINANCE', 'CYCLICAL') THEN 'cash' END,
  CASE WHEN ebit IS NULL AND archetype IN ('FINANCE', 'CYCLICAL', 'LOSS', 'GENERAL') THEN 'ebit' END, CASE WHEN revenue IS NULL AND archetype NOT IN ('HOLDING', 'PRE_REVENUE', 'ASSET') THEN 'revenue' END) AS missing FROM a)
SELECT issuer, fiscal_year, archetype, CASE archetype WHEN 'FINANCE' THEN 'RIM' WHEN 'HOLDING' THEN 'SOTP' WHEN 'PRE_REVENUE' THEN 'RNPV' WHEN 'PIPELINE' THEN 'RNPV' WHEN 'ASSET' THEN 'NAV' WHEN 'CYCLICAL' THEN 'NORMALIZED_FCFF' WHEN 'LOSS' THEN 'SCENARIO_DCF' ELSE 'FCFF' END AS method,
  missing, CASE WHEN missing = '' THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_DATA' END AS status FROM m""",
    "rim_value": WIDE_SQL + """,
s0 AS (SELECT issuer, fiscal_year, revenue / 2 AS b0, 0::DOUBLE AS pv0, roe, 0.1 + 0.25 * (roe - 0.1) AS rt FROM (SELECT *, greatest(-0.2, least(0.35, ebit / revenue / 4))::DOUBLE AS roe FROM wide WHERE revenue > 0 AND ebit IS NOT NULL))""" + _RIM_STEPS + """
SELECT issuer, fiscal_year, round(b0, 4) AS book, round(b0 + pv5 + b5 * 1.02 * (rt - 0.1) / 0.08 / pow(1.1, 5), 2) AS value FROM s5""",
    "rnpv_value": """
WITH a AS (SELECT p_brand, p_retailprice AS launch, [0.138, 0.210, 0.590, 1.0][p_size % 4 + 1]::DOUBLE AS odds, [7, 5, 2, 0][p_size % 4 + 1] AS years FROM part)
SELECT p_brand, count(*) AS assets, round(sum(launch * odds / pow(1.12, years) - coalesce(list_sum([launch * 0.01 / pow(1.12, t) FOR t IN range(1, years + 1)]), 0)), 4) AS value FROM a GROUP BY 1""",
    "nav_value": with_views("securities", "prices") + """,
l AS (SELECT ticker, arg_max(close, price_date) AS close FROM prices GROUP BY 1)
SELECT market, count(*) AS holdings, round(sum(close * shares * (0.3 + 0.05 * (shares % 10)) * 0.8), 2) AS nav FROM l JOIN securities USING (ticker) GROUP BY 1""",
    "reverse_dcf_surface": WIDE_SQL + """,
p AS (SELECT g::DOUBLE AS g, m::DOUBLE AS m FROM unnest([-0.05, 0.0, 0.05, 0.10, 0.15]) AS a(g), unnest([0.05, 0.10, 0.15, 0.20, 0.25]) AS b(m)),
f AS (SELECT g, m, t, pow(1 + g, t) * (m * 0.76 - 0.01) AS f FROM p, range(1, 6) AS r(t)),
u AS (SELECT g, m, sum(f / pow(1.105, t)) + max(f) FILTER (WHERE t = 5) * 1.02 / 0.085 / pow(1.105, 5) AS u FROM f GROUP BY 1, 2),
x AS (SELECT issuer, fiscal_year, g, m, round(abs(revenue * u / (3 * cash) - 1), 9) AS error FROM wide, u WHERE revenue > 0 AND cash > 0)
SELECT issuer, fiscal_year, g AS growth, m AS margin, round(error, 6) AS error FROM x QUALIFY row_number() OVER (PARTITION BY issuer, fiscal_year ORDER BY x.error, g, m) = 1""",
    "weighted_quantile": """
WITH b AS (SELECT l_partkey, l_extendedprice, sum(l_quantity::DECIMAL(18,2)) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS c, sum(w) OVER (PARTITION BY l_partkey) AS t FROM b)
SELECT l_partkey, min(l_extendedprice) AS median FROM r WHERE 2 * c >= t GROUP BY 1""",
    "hierarchical_percentile": """
WITH r AS (SELECT c_custkey, count(*) OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment) AS n1, CASE WHEN count(*) OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment) > 1 THEN 100 * (rank() OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment, c_acctbal) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY n_regionkey, c_nationkey, c_mktsegment) - 1) ELSE 50.0 END AS p1,
  count(*) OVER (PARTITION BY n_regionkey, c_nationkey) AS n2, CASE WHEN count(*) OVER (PARTITION BY n_regionkey, c_nationkey) > 1 THEN 100 * (rank() OVER (PARTITION BY n_regionkey, c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY n_regionkey, c_nationkey, c_acctbal) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY n_regionkey, c_nationkey) - 1) ELSE 50.0 END AS p2,
  count(*) OVER (PARTITION BY n_regionkey) AS n3, CASE WHEN count(*) OVER (PARTITION BY n_regionkey) > 1 THEN 100 * (rank() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY n_regionkey, c_acctbal) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY n_regionkey) - 1) ELSE 50.0 END AS p3
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN n1 >= 20 THEN 'NATION_SEGMENT' WHEN n2 >= 20 THEN 'NATION' WHEN n3 >= 20 THEN 'REGION' END AS class, CASE WHEN n1 >= 20 THEN n1 WHEN n2 >= 20 THEN n2 WHEN n3 >= 20 THEN n3 END AS members,
  round(CASE WHEN n1 >= 20 THEN p1 WHEN n2 >= 20 THEN p2 WHEN n3 >= 20 THEN p3 END, 6) AS percentile FROM r""",
    "ttm_flows": """
WITH y AS (SELECT o_custkey AS issuer, year(o_orderdate)::INTEGER AS year, sum(o_totalprice::DECIMAL(18,2)) AS f, sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE month(o_orderdate) <= 6) AS h FROM orders GROUP BY 1, 2)
SELECT a.issuer, a.year, (b.f + a.h - b.h)::DOUBLE AS ttm FROM y a LEFT JOIN y b ON a.issuer = b.issuer AND b.year = a.year - 1""",
}
