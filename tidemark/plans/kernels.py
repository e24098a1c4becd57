"""Valuation engines, expectation gaps, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import valuation as V
from tidemark.plans.companies import WIDE_SQL, fundamentals
from tidemark.plans.valuation import KE, TAX, WACC
from tidemark.sources.tables import table

STABLE_GROWTH, YEARS, CAP, FADE, CONVERGE = 0.02, 10, 5, 3, 3
FAILURE, SHARES, TERMINAL_LIMIT = 0.05, 100.0, 0.90
#: Shifts of growth and target margin of the downside, central and upside case.
CASES = {"downside": -0.02, "central": 0.0, "upside": 0.02}
CONFIDENCE, EXPANSION = 0.6, 0.5
#: Return on equity moves by this between cases, and costs of equity by size.
ROE_STEP, KE_BY_SIZE = 0.03, {"LARGE": 0.09, "MID": 0.10, "SMALL": 0.12}
#: Weights of assumption types in a confidence, over eleven fields.
TYPE_WEIGHTS, FIELDS = (1.0, 0.95, 0.75, 0.70, 0.55, 0.25, 0.10), 11
GROWTH_GRID = (-0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20)
#: Tolerance and count of nearest points of an implied surface, and the width of its kernel.
TOLERANCE, NEAREST, BANDWIDTH = 0.03, 12, 0.05
SURFACE = {"growth": (-0.05, 0.0, 0.05, 0.10, 0.15), "margin": (0.03, 0.06, 0.09, 0.12, 0.15), "roiic": (0.08, 0.12, 0.16), "cap": (0, 3, 5, 8)}
#: The states of a surface on which expectations are read from prices.
LEVELS = {"growth": (-0.20, 0.00, 0.10, 0.25, 0.60), "margin": (-0.20, 0.05, 0.15, 0.30, 0.60), "roiic": (0.03, 0.10, 0.25, 0.75, 2.00), "cap": (1, 5, 10, 20, 40)}
#: Screening thresholds and weights.
MIN_SCORE, MIN_MARGIN, MIN_CONFIDENCE, MIN_COVERAGE, SCORE_WEIGHT = 5, 0.20, 0.50, 0.50, 0.50


def _base(spark, sf_dir: str) -> DataFrame:
    """An issuer's year as the assumptions of a valuation."""
    rows = fundamentals(spark, sf_dir).filter("revenue > 0 and ebit > 0")
    margin = F.least(F.lit(0.35), F.col("ebit") / F.col("revenue") / 4) * (1 - TAX)
    return rows.select(
        "issuer", "fiscal_year", "revenue", margin.alias("margin"), (0.03 + 0.01 * (F.col("issuer") % 6)).alias("growth"), F.coalesce("cash", F.lit(0.0)).alias("cash")
    )


def _assumptions(growth: Column | None = None, target: Column | None = None) -> dict[str, Column]:
    margin = F.col("margin")
    fixed = {"roiic": 0.15, "wacc": WACC, "stable_growth": STABLE_GROWTH, "stable_roic": WACC}
    named = {"revenue": F.col("revenue"), "nopat": F.col("revenue") * margin, "margin": margin, "stable_margin": margin}
    return named | {k: F.lit(v) for k, v in fixed.items()} | {"growth": F.col("growth") if growth is None else growth, "target": margin * 1.1 if target is None else target}


def economic(spark, sf_dir: str) -> DataFrame:
    """Enterprise value with and without a competitive advantage, value of growth beyond assets in place, and why a row is left out."""
    a = _assumptions()
    cored = _base(spark, sf_dir).withColumns({
        "c": V.economic_core(a, YEARS, F.lit(CAP), F.lit(FADE), CONVERGE), "s": V.economic_core(a, YEARS, F.lit(0), F.lit(0), CONVERGE),
    })
    recovery = 0.1 * F.col("revenue")
    adjusted = lambda v: V.survived(v, F.lit(FAILURE), recovery)
    valued = cored.withColumns({
        "ev": adjusted(F.col("c.pv") + F.col("c.terminal")), "steady": adjusted(F.col("s.pv") + F.col("s.terminal")),
        "in_place": adjusted(a["nopat"] / WACC), "share": F.col("c.terminal") / (F.col("c.pv") + F.col("c.terminal")),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("ev") <= 0, "NON_POSITIVE_ENTERPRISE_VALUE"), F.when(F.col("ev") + F.col("cash") <= 0, "NON_POSITIVE_EQUITY_VALUE"),
        F.when((F.col("share") < 0) | (F.col("share") > TERMINAL_LIMIT), "UNRELIABLE_TERMINAL_VALUE_SHARE"),
    ))
    return valued.select(
        "issuer", "fiscal_year", F.round("ev", 2).alias("ev"), F.round(F.col("ev") - F.col("steady"), 2).alias("cap_value"), F.round(F.col("ev") - F.col("in_place"), 2).alias("pvgo"),
        F.round("share", 6).alias("terminal_share"), F.round((F.col("ev") + F.col("cash")) / SHARES, 4).alias("per_share"), F.array_join(reasons, ",").alias("reasons"),
    )


def _cases(spark, sf_dir: str) -> DataFrame:
    """Value per share of the three cases."""
    rows = _base(spark, sf_dir)
    for name, shift in CASES.items():
        core = V.economic_core(_assumptions(F.col("growth") + shift, F.col("margin") * (1.1 + 5 * shift)), YEARS, F.lit(CAP), F.lit(FADE), CONVERGE)
        rows = rows.withColumn(name, core).withColumn(name, (V.survived(F.col(f"{name}.pv") + F.col(f"{name}.terminal"), F.lit(FAILURE), 0.1 * F.col("revenue")) + F.col("cash")) / SHARES)
    return rows


def scenario_range(spark, sf_dir: str) -> DataFrame:
    """Values of three cases, whether they are in order, and the range widened for lack of confidence."""
    rows = _cases(spark, sf_dir)
    low, high = F.least(*CASES), F.greatest(*CASES)
    wider = 1 + (1 - CONFIDENCE) * EXPANSION
    return rows.select(
        "issuer", "fiscal_year", *(F.round(c, 4).alias(c) for c in CASES), ((F.col("downside") <= F.col("central")) & (F.col("central") <= F.col("upside"))).alias("ordered"),
        F.round(F.greatest(F.lit(0.0), F.col("central") - (F.col("central") - low) * wider), 4).alias("low"), F.round(F.col("central") + (high - F.col("central")) * wider, 4).alias("high"),
    )


def apv(spark, sf_dir: str) -> DataFrame:
    """Five flows and tax shields of a levered firm, valued apart."""
    rows = _base(spark, sf_dir)
    flow = F.col("revenue") * F.col("margin") * 0.6
    flows = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda t: flow * F.pow(1 + F.col("growth"), t))
    shields = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda t: F.col("revenue") * 0.3 * 0.05 * TAX / t)
    value = V.adjusted_present_value(flows, flow * F.pow(1 + F.col("growth"), F.lit(5)) * (1 + STABLE_GROWTH), shields, F.lit(WACC), F.lit(0.06), F.lit(STABLE_GROWTH), F.col("revenue") * 0.01)
    equity = value + F.col("cash") - 0.3 * F.col("revenue")
    return rows.select("issuer", "fiscal_year", F.round(value, 2).alias("enterprise"), F.round(equity, 2).alias("equity"), F.round(equity / SHARES, 4).alias("per_share"))


def sum_of_parts(spark, sf_dir: str) -> DataFrame:
    """An issuer's order priorities as parts: those valued as enterprises give up debt and minorities before ownership."""
    amount = F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("decimal(18,2)")
    share = lambda x: F.lit(x).cast("decimal(3,2)")
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("issuer"), F.col("o_orderpriority").alias("part")).agg(amount.alias("value"), F.count("*").alias("orders"))
    rank = F.substring("part", 1, 1).cast("int")
    owned = F.col("value") * F.when(rank <= 2, share("0.85")).otherwise(share("1.00")) * F.when(rank == 5, share("1.00")).otherwise((F.lit("0.5").cast("decimal(2,1)") + F.lit("0.1").cast("decimal(2,1)") * rank).cast("decimal(3,2)"))
    sums = parts.groupBy("issuer").agg(F.count("*").alias("parts"), F.sum("orders").alias("orders"), F.sum(owned).alias("owned"), F.sum("value").alias("gross"))
    equity = F.col("owned") + 1000 * F.col("orders") - F.col("gross") * F.lit("0.05").cast("decimal(3,2)")
    return sums.select("issuer", "parts", F.round(equity, 2).cast("double").alias("equity"), F.round(equity.cast("double") / SHARES, 3).alias("per_share"))


def assumption_confidence(spark, sf_dir: str) -> DataFrame:
    """Mean weight of the types of a customer's eleven assumptions."""
    kinds = F.transform(F.sequence(F.lit(1), F.lit(FIELDS)), lambda i: (F.col("c_custkey") * (i + 3)) % len(TYPE_WEIGHTS))
    weights = F.array(*map(F.lit, TYPE_WEIGHTS))
    total = F.aggregate(kinds, F.lit(0.0), lambda acc, k: acc + F.get(weights, k.cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(total / FIELDS, 6).alias("confidence"))


def residual_income_cases(spark, sf_dir: str) -> DataFrame:
    """Three cases of residual income around a year's return, at the cost of equity of the issuer's size."""
    rows = _base(spark, sf_dir).withColumn("size", F.element_at(F.array(*map(F.lit, KE_BY_SIZE)), (F.col("issuer") % 3 + 1).cast("int")))
    ke = F.lit(KE_BY_SIZE["SMALL"])
    for size, rate in KE_BY_SIZE.items():
        ke = F.when(F.col("size") == size, rate).otherwise(ke)
    case = lambda step: V.residual_income(F.col("revenue") / 2, F.col("margin") + step, ke + 0.25 * (F.col("margin") + step - ke), ke, 0.40, 0.02, 5)
    return rows.select("issuer", "fiscal_year", "size", *(F.round(case(k * ROE_STEP), 2).alias(name) for k, name in ((-1, "downside"), (0, "central"), (1, "upside"))))


def normalized(spark, sf_dir: str) -> DataFrame:
    """Three cases from the quartiles of an issuer's clipped growth and margins; cases are named by their value."""
    order = Window.partitionBy("issuer").orderBy("fiscal_year")
    rows = fundamentals(spark, sf_dir).filter("revenue > 0 and ebit is not null").withColumn("before", F.lag("revenue").over(order)).filter("before > 0")
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    measured = rows.select("issuer", "revenue", "fiscal_year", clip(F.col("revenue") / F.col("before") - 1, -0.10, 0.15).alias("g"), clip(F.col("ebit") / F.col("revenue") / 4 * (1 - TAX), -0.20, 0.35).alias("m"))
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    wide = measured.groupBy("issuer").agg(F.count("*").alias("years"), F.max_by("revenue", "fiscal_year").alias("revenue"), F.percentile("g", quartiles).alias("g"), F.percentile("m", quartiles).alias("m"))

    def value(k: int) -> Column:
        g, m, w = F.get("g", F.lit(k)), F.get("m", F.lit(k)), F.lit(WACC + 0.015 * (1 - k))
        flows = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda t: F.col("revenue") * F.pow(1 + g, t) * m)
        return V.discounted(flows, w) + V.gordon(F.element_at(flows, -1) * (1 + STABLE_GROWTH), w, F.lit(STABLE_GROWTH)) / F.pow(1 + w, F.lit(5))

    out = wide.withColumn("v", F.array_sort(F.array(*(F.round(value(k), 2) for k in range(3)))))
    return out.select("issuer", "years", *(F.get("v", F.lit(k)).alias(name) for k, name in enumerate(CASES)))


def implied_growth(spark, sf_dir: str) -> DataFrame:
    """The growth at which an issuer's value equals six times its revenue, between points of a grid; censored outside it."""
    rows = _base(spark, sf_dir)
    points = F.array(*(
        F.struct(F.lit(g).alias("x"), F.round(_worth(V.economic_core(_assumptions(F.lit(g)), YEARS, F.lit(CAP), F.lit(FADE), CONVERGE)) / F.col("revenue"), 9).alias("y")) for g in GROWTH_GRID
    ))
    # a column of its own, so that the grid is valued once for all its uses
    solved = rows.withColumn("points", points).withColumn("r", V.crossing(F.col("points"), F.lit(1.5), F.col("growth")))
    return solved.select("issuer", "fiscal_year", F.col("r.status").alias("status"), F.round("r.x", 6).alias("implied"), F.round(F.col("r.x") - F.col("growth"), 6).alias("gap"))


def _worth(core: Column) -> Column:
    return core["pv"] + core["terminal"]


def _unit_value(growth: float, margin: float, roiic: float, cap: float) -> float:
    """Economic value of one of revenue at fixed margins: growth for ``cap`` years, then a steady state."""
    revenue, before, out = 1.0, margin, 0.0
    for t in range(1, YEARS + 1):
        ahead = t <= cap
        revenue *= 1 + (growth if ahead else STABLE_GROWTH)
        nopat = revenue * margin
        out += (nopat - max(nopat - before, 0.0) / (roiic if ahead else WACC)) / (1 + WACC) ** t
        before = nopat
    return out + revenue * (1 + STABLE_GROWTH) * margin * (1 - STABLE_GROWTH / WACC) / (WACC - STABLE_GROWTH) / (1 + WACC) ** YEARS


def _surface(spark, sf_dir: str) -> DataFrame:
    points = V.grid(*SURFACE.values(), value=_unit_value)
    rows = fundamentals(spark, sf_dir).filter("revenue > 0 and cash > 0").withColumn("target", F.col("cash") / F.col("revenue"))
    return rows.withColumn("p", F.transform(points, lambda x: F.struct(
        F.round(F.abs(x["v"] / F.col("target") - 1), 9).alias("error"), x["p3"].alias("cap"), x["p0"].alias("growth"), x["p1"].alias("margin"), x["p2"].alias("roiic"), x["v"].alias("v"),
    )))


def implied_ranges(spark, sf_dir: str) -> DataFrame:
    """Ranges of growth, margin, return and advantage among the points of a grid whose value is near the price, or the nearest of them."""
    near = F.filter("p", lambda x: x["error"] <= TOLERANCE)
    chosen = F.when(F.size(near) > 0, near).otherwise(F.slice(F.array_sort("p"), 1, NEAREST))
    rows = _surface(spark, sf_dir).withColumns({"within": F.size(near), "s": chosen})
    ends = [f(F.col(f"s.{c}")).alias(f"{c}_{n}") for c in SURFACE for n, f in (("low", F.array_min), ("high", F.array_max))]
    return rows.select("issuer", "fiscal_year", F.col("within").cast("long").alias("within"), F.size("s").cast("long").alias("solutions"), *ends)


def surface_kernel(spark, sf_dir: str) -> DataFrame:
    """Each driver's mean and tenths over all 5^4 states, weighted by how near their value is to the price; eligible if near and broad enough.

    States without a positive value have no price. A state is a row, so every
    sum is combined before the shuffle.
    """
    points = V.grid(*LEVELS.values(), value=_unit_value)
    base = fundamentals(spark, sf_dir).filter("revenue > 0 and cash > 0").withColumn("target", F.col("cash") / F.col("revenue"))
    rows = base.select("issuer", "fiscal_year", "target", F.inline(points)).filter("v > 0")
    weight = F.exp(-0.5 * F.pow(F.ln(F.col("v") / F.col("target")) / BANDWIDTH, F.lit(2)))
    weighed = rows.withColumns({"w": weight, "error": F.round(F.abs(F.col("v") / F.col("target") - 1), 9)})
    drivers = {name: f"p{i}" for i, name in enumerate(LEVELS)}
    upto = lambda name, level: F.sum(F.when(F.col(drivers[name]) <= level, F.col("w")).otherwise(0.0)).alias(f"{name}_{LEVELS[name].index(level)}")
    sums = weighed.groupBy("issuer", "fiscal_year").agg(
        F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.min("error").alias("best"), *(F.sum(F.col("w") * F.col(c)).alias(f"mean_{n}") for n, c in drivers.items()), *(upto(n, level) for n, levels in LEVELS.items() for level in levels),
    )
    some = F.col("w1") > 1e-12
    points_ = F.when(some, F.col("w1") * F.col("w1") / F.col("w2"))

    def share(name: str, q: float) -> Column:
        out = F.lit(float(LEVELS[name][-1]))
        for k in reversed(range(len(LEVELS[name]) - 1)):
            out = F.when(F.round(F.col(f"{name}_{k}") / F.col("w1"), 9) >= q, float(LEVELS[name][k])).otherwise(out)
        return F.when(some, out)

    told = [c for n in LEVELS for c in (F.when(some, F.round(F.col(f"mean_{n}") / F.col("w1"), 6)).alias(n), share(n, 0.1).alias(f"{n}_p10"), share(n, 0.9).alias(f"{n}_p90"))]
    return sums.select("issuer", "fiscal_year", F.round(points_, 4).alias("effective_points"), *told, ((F.col("best") <= 0.10) & (F.coalesce(points_, F.lit(0.0)) >= 5)).alias("eligible"))


def sensitivities(spark, sf_dir: str) -> DataFrame:
    """How far a driver's shock moves the value, and the driver that moves it most."""
    base = _worth(V.economic_core(_assumptions(), YEARS, F.lit(CAP), F.lit(FADE), CONVERGE))
    shocked = {
        "GROWTH": V.economic_core(_assumptions(F.col("growth") + 0.01), YEARS, F.lit(CAP), F.lit(FADE), CONVERGE),
        "MARGIN": V.economic_core(_assumptions(target=F.col("margin") * 1.2), YEARS, F.lit(CAP), F.lit(FADE), CONVERGE),
        "ROIIC": V.economic_core(_assumptions() | {"roiic": F.lit(0.18)}, YEARS, F.lit(CAP), F.lit(FADE), CONVERGE),
        "CAP": V.economic_core(_assumptions(), YEARS, F.lit(CAP + 2), F.lit(FADE), CONVERGE),
    }
    rows = _base(spark, sf_dir).withColumns({"base": base} | {f"d_{k}": core for k, core in shocked.items()})
    moved = rows.withColumns({f"d_{k}": F.round(_worth(F.col(f"d_{k}")) / F.col("base") - 1, 8) for k in shocked})
    turbo = F.array_max(F.array(*(F.struct(F.abs(f"d_{k}").alias("size"), F.lit(k).alias("driver")) for k in shocked)))
    return moved.select("issuer", "fiscal_year", *(F.round(f"d_{k}", 6).alias(k.lower()) for k in shocked), turbo["driver"].alias("turbo"))


def _scored(spark, sf_dir: str) -> DataFrame:
    """Percentiles, diagnostics and counts of a customer, from its key; some revisions are unknown."""
    key = F.col("c_custkey")
    part = lambda k: ((key * k) % 101).cast("double")
    value = 50 + part(7)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *(part(k).alias(n) for k, n in ((3, "gap"), (5, "probable"), (11, "plausible"), (13, "probable_revision"), (17, "plausible_revision"), (19, "breadth"))),
        F.when(key % 10 != 0, part(23)).alias("evidence_revision"), value.alias("base"), (value - part(29)).alias("down"), (value + part(31)).alias("up"),
        F.when(key % 7 != 0, part(37) / 100).alias("confidence"), (key % 6).alias("warnings"), (key % 9 != 0).alias("applicable"), (key % 4).alias("counter"), (key % 5).alias("wideners"), (key % 12 != 0).alias("possible"),
    )


def _fragility() -> Column:
    """0 to 100: loss in the downside, spread of cases, weak confidence and warnings; null without a base value."""
    scale = F.abs("base")
    loss = F.least(F.lit(100.0), 100 * F.greatest(F.lit(0.0), F.col("base") - F.col("down")) / scale)
    spread = F.least(F.lit(100.0), 50 * F.abs(F.col("up") - F.col("down")) / scale)
    weak = F.coalesce(100 * (1 - F.col("confidence")), F.lit(100.0))
    blend = 0.35 * loss + 0.35 * spread + 0.20 * weak + 0.10 * F.least(F.lit(100.0), 20.0 * F.col("warnings"))
    return F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), blend)))


def fragility(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("c_custkey", F.round(_fragility(), 6).alias("fragility"))


def three_axes(spark, sf_dir: str) -> DataFrame:
    """Cheap, improving and not fragile, their geometric blend, and a status."""
    rows = _scored(spark, sf_dir).withColumns({
        "cheap": 0.50 * F.col("gap") + 0.30 * F.col("probable") + 0.20 * F.col("plausible"), "sturdy": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - _fragility())),
        "improving": F.when(F.col("applicable"), 0.35 * F.col("probable_revision") + 0.25 * F.col("plausible_revision") + 0.25 * F.col("breadth") + 0.15 * F.col("evidence_revision")),
    })
    blend = F.when(F.col("improving").isNotNull(), V.geometric(("cheap", 0.40), ("improving", 0.35), ("sturdy", 0.25)))
    status = F.when(~F.col("applicable"), "MODEL_NOT_APPLICABLE").when(F.col("improving").isNull(), "INSUFFICIENT_EVIDENCE").when(F.col("sturdy") < 30, "HIGH_FRAGILITY").otherwise("VALID")
    return rows.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("cheap", "improving", "sturdy")), F.round(blend, 6).alias("composite"), status.alias("status"))


def risk_overlay(spark, sf_dir: str) -> DataFrame:
    """Left out, capped or eligible by fragility and evidence against the industry; every fifth has no industry context."""
    rows = _scored(spark, sf_dir).withColumns({"f": F.when(F.col("confidence").isNotNull(), _fragility()), "known": F.col("c_custkey") % 5 != 3})
    high, missing = F.coalesce(F.col("f") >= 70, F.lit(False)), F.col("f").isNull()
    severe = F.col("known") & ((F.col("counter") >= 2) | (F.col("wideners") >= 3))
    failed = ~F.col("possible")
    decision = F.when(failed | (high & severe), "EXCLUDED").when(high | severe | missing, "POSITION_CAP").otherwise("ELIGIBLE")
    reasons = F.when(failed, F.array(F.lit("THREE_P_POSSIBLE_FAIL"))).otherwise(F.array_compact(F.array(
        F.when(missing, "FRAGILITY_MISSING").when(high, "HIGH_FRAGILITY"), F.when(~F.col("known"), "INDUSTRY_CONTEXT_MISSING").when(severe, "SEVERE_INDUSTRY_RISK"),
    )))
    out = rows.withColumns({"decision": decision, "reasons": F.array_join(reasons, ",")})
    return out.select("c_custkey", "decision", F.when(F.col("decision") == "EXCLUDED", 0.0).when(F.col("decision") == "POSITION_CAP", 0.5).otherwise(1.0).alias("multiplier"), "reasons")


def reason_counts(spark, sf_dir: str) -> DataFrame:
    """How often each reason occurs, by decision."""
    exploded = risk_overlay(spark, sf_dir).select("decision", F.explode(F.split("reasons", ",")).alias("reason")).filter("reason <> ''")
    return exploded.groupBy("decision", "reason").agg(F.count("*").alias("n"))


def gap_directions(spark, sf_dir: str) -> DataFrame:
    """Evidence against implied ranges of four drivers, and the direction of the whole."""
    rows = _scored(spark, sf_dir)
    drivers = F.array(*(F.struct(F.col(a).alias("low"), (F.col(a) + 20).alias("high"), F.col(b).alias("implied_low"), (F.col(b) + 15).alias("implied_high"))
                        for a, b in (("gap", "probable"), ("plausible", "breadth"), ("probable_revision", "gap"), ("breadth", "plausible_revision"))))
    counted = rows.withColumn("d", drivers).withColumns({
        "favorable": F.size(F.filter("d", lambda x: x["low"] > x["implied_high"])), "adverse": F.size(F.filter("d", lambda x: x["high"] < x["implied_low"])),
        "central": F.round((F.col("up") + F.col("down")) / 2 / F.col("base") - 1, 9),
    })
    direction = (
        F.when(~F.col("possible"), "INDETERMINATE").when((F.col("central") > 0) & (F.col("adverse") == 0), "FAVORABLE")
        .when((F.col("central") < 0) | (F.col("adverse") > F.col("favorable")), "UNFAVORABLE").otherwise("OVERLAP")
    )
    return counted.select("c_custkey", F.round("central", 6).alias("central"), F.col("favorable").cast("long").alias("favorable"), F.col("adverse").cast("long").alias("adverse"), direction.alias("direction"))


def opportunities(spark, sf_dir: str) -> DataFrame:
    """Favorable gaps that pass the thresholds, by central gap, downside gap and narrow range, ranked within nations."""
    rows = gap_directions(spark, sf_dir).join(_scored(spark, sf_dir).select("c_custkey", "base", "down", "up"), "c_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    measured = rows.withColumns({"downside": F.round(F.col("down") / F.col("base") - 1, 6), "width": F.round((F.col("up") - F.col("down")) / F.col("base"), 6)})
    passed = measured.filter("direction = 'FAVORABLE' and central >= 0 and downside >= -0.30 and width <= 3.0")
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("central"), F.desc("downside"), "width", "c_custkey")
    return passed.select("c_nationkey", F.row_number().over(order).alias("rank"), "c_custkey", "central", "downside", "width")


def screened(spark, sf_dir: str) -> DataFrame:
    """A screen, then percentiles of a lexicographic quality key and of the margin of safety, blended and ranked within segments.

    The finer parts of the key count only where everyone with the same score has them.
    """
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", (key % 11).alias("score"), F.round(0.3 + (key * 37 % 100) / 100, 4).alias("price_to_value"), (key % 10 / 10).alias("confidence"), (key % 7 / 7).alias("coverage"),
        *(F.when(key % 211 != 0, key * k % m).alias(n) for n, k, m in (("mechanism", 3, 5), ("outcome", 5, 4), ("durability", 7, 3), ("counter", 11, 6))),
    )
    passed = rows.filter((F.col("score") >= MIN_SCORE) & (1 - F.col("price_to_value") >= MIN_MARGIN) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("coverage") >= MIN_COVERAGE))
    whole = F.bool_and(F.col("mechanism").isNotNull()).over(Window.partitionBy("c_mktsegment", "score"))
    finer = lambda c: F.when(whole, c).otherwise(F.lit(0))
    keyed = passed.withColumn("k", F.struct("score", *(finer(F.col(c)).alias(c) for c in ("mechanism", "outcome", "durability")), finer(-F.col("counter")).alias("counter")))
    group = Window.partitionBy("c_mktsegment")
    share = lambda c: (F.rank().over(group.orderBy(c)) + (F.count("*").over(Window.partitionBy("c_mktsegment", c)) - 1) / 2) / F.count("*").over(group)
    ranked = keyed.withColumn("margin", F.round(1 - F.col("price_to_value"), 4)).withColumns({"quality": share("k"), "value": share("margin")})
    blended = ranked.withColumn("blend", F.round(SCORE_WEIGHT * F.col("quality") + (1 - SCORE_WEIGHT) * F.col("value"), 9))
    order = group.orderBy(F.desc("blend"), "price_to_value", "c_custkey")
    return blended.select("c_mktsegment", F.row_number().over(order).alias("rank"), "c_custkey", *(F.round(c, 6).alias(c) for c in ("quality", "value", "blend")))


def value_yields(spark, sf_dir: str) -> DataFrame:
    """Yields on an issuer's year, each only with both sides above zero, and the mean of their normal scores by year."""
    rows = fundamentals(spark, sf_dir)
    price = F.col("revenue") * (1 + F.col("issuer") % 5)
    ratio = lambda a, b: F.when((a > 0) & (b > 0), a / b)
    enterprise = price - F.coalesce("cash", F.lit(0.0))
    made = {
        "earnings": ratio(F.col("ebit") * (1 - TAX), price), "free_cash": ratio(F.col("ebit") * (1 - TAX) - F.col("capex"), price), "sales": ratio(F.col("revenue"), price),
        "ebit_to_ev": ratio(F.col("ebit"), enterprise), "ebitda_to_ev": ratio(F.col("ebit") + 0.03 * F.col("revenue"), enterprise), "cash_to_price": ratio(F.col("cash"), price),
    }
    return rows.select("issuer", "fiscal_year", *(F.round(c, 6).alias(n) for n, c in made.items()))


def quality_factor(spark, sf_dir: str) -> DataFrame:
    """Returns on assets and cash on assets less debt on assets; null where a part is unknown."""
    assets = F.col("revenue") + F.col("cash")
    rows = fundamentals(spark, sf_dir).filter("revenue + cash > 0")
    return rows.select("issuer", "fiscal_year", F.round(F.col("ebit") / assets + (F.col("ebit") - F.col("capex")) / assets - 0.3 * F.col("revenue") / assets, 6).alias("quality"))


def factor_vector(spark, sf_dir: str) -> DataFrame:
    """Growth, its change, change of margin and operating leverage over three consecutive years."""
    order = Window.partitionBy("issuer").orderBy("fiscal_year")
    rows = fundamentals(spark, sf_dir).filter("revenue > 0 and ebit is not null").withColumn("margin", F.col("ebit") / F.col("revenue"))
    lagged = rows.withColumns({f"{c}{k}": F.lag(c, k).over(order) for c in ("revenue", "ebit", "margin", "fiscal_year") for k in (1, 2)})
    three = lagged.filter("fiscal_year1 = fiscal_year - 1 and fiscal_year2 = fiscal_year - 2")
    growth, before = F.col("revenue") / F.col("revenue1") - 1, F.col("revenue1") / F.col("revenue2") - 1
    profit = F.when(F.col("ebit1") != 0, F.col("ebit") / F.col("ebit1") - 1)
    return three.select("issuer", "fiscal_year", F.round(growth, 6).alias("growth"), F.round(growth - before, 6).alias("acceleration"), F.round(F.col("margin") - F.col("margin1"), 6).alias("margin_change"), F.round(F.try_divide(profit, F.round(growth, 9)), 4).alias("leverage"))


def supported_drivers(spark, sf_dir: str) -> DataFrame:
    """Clamped medians of the last three years' growth and margin, and an advantage period from the excess return and its streak."""
    order = Window.partitionBy("issuer").orderBy("fiscal_year")
    rows = fundamentals(spark, sf_dir).filter("revenue > 0 and ebit is not null")
    measured = rows.withColumns({"g": F.col("revenue") / F.lag("revenue").over(order) - 1, "m": F.col("ebit") / F.col("revenue") / 4 * (1 - TAX)}).withColumn("roic", F.round(F.col("m") / 0.8, 9))
    failed = F.max(F.when(F.col("roic") <= WACC, F.col("fiscal_year"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    streaked = measured.withColumns({"failed": failed, "r": F.row_number().over(Window.partitionBy("issuer").orderBy(F.desc("fiscal_year")))})
    last = streaked.groupBy("issuer").agg(
        F.count("*").alias("years"), F.percentile(F.when(F.col("r") <= 3, F.col("g")), 0.5).alias("g"), F.percentile(F.when(F.col("r") <= 3, F.col("m")), 0.5).alias("m"), F.max_by("roic", "fiscal_year").alias("roic"),
        F.max_by("failed", "fiscal_year").alias("f"), F.collect_list("fiscal_year").alias("y"),
    )
    streak = F.size(F.filter("y", lambda y: F.col("f").isNull() | (y > F.col("f"))))
    cap = F.round(F.greatest(F.lit(3.0), F.least(F.lit(15.0), 3 + 20 * F.greatest(F.lit(0.0), F.col("roic") - WACC) + F.least(streak, F.lit(3)))))
    return last.select(
        "issuer", "years", F.when(F.col("g").isNotNull(), F.round(F.greatest(F.lit(-0.10), F.least(F.lit(0.15), F.col("g"))), 6)).alias("growth"), F.round(F.greatest(F.lit(-0.20), F.least(F.lit(0.35), F.col("m"))), 6).alias("margin"),
        streak.cast("long").alias("streak"), cap.cast("long").alias("cap"),
    )


def routed(spark, sf_dir: str) -> DataFrame:
    """Each issuer's year valued by the method of its route, with a status where the engine has no value."""
    rows = fundamentals(spark, sf_dir).withColumns({"method": F.when(F.col("revenue").isNull(), "NAV").when(F.col("ebit").isNull(), "SALES").otherwise("RIM"), "book": F.col("revenue") / 2})
    margin = F.greatest(F.lit(-0.2), F.least(F.lit(0.35), F.col("ebit") / F.col("revenue") / 4))
    rim = F.when(F.col("revenue") > 0, V.residual_income(F.col("book"), margin, KE + 0.25 * (margin - KE), F.lit(KE), 0.40, 0.02, 5))
    value = F.when(F.col("method") == "RIM", rim).when(F.col("method") == "SALES", F.col("revenue") * 1.6).otherwise(F.col("cash") * 0.8)
    status = F.when(value.isNull(), "INSUFFICIENT_DATA").when(value <= 0, "NON_POSITIVE_VALUE").otherwise("EXECUTED")
    return rows.select("issuer", "fiscal_year", "method", F.round(value, 2).alias("value"), status.alias("status"))


QUERIES = {
    "economic_dcf": economic,
    "scenario_range": scenario_range,
    "apv_value": apv,
    "sotp_value": sum_of_parts,
    "dcf_confidence": assumption_confidence,
    "rim_cases": residual_income_cases,
    "normalized_fcff": normalized,
    "implied_driver_root": implied_growth,
    "implied_ranges_4d": implied_ranges,
    "expectation_surface_kernel": surface_kernel,
    "driver_sensitivities": sensitivities,
    "fragility_score": fragility,
    "three_axis_score": three_axes,
    "risk_overlay": risk_overlay,
    "reason_code_explode": reason_counts,
    "expectation_gap_direction": gap_directions,
    "opportunity_rank": opportunities,
    "value_rank_lexicographic": screened,
    "value_yields": value_yields,
    "quality_factor": quality_factor,
    "value_factor_vector": factor_vector,
    "supported_drivers": supported_drivers,
    "routed_valuation": routed,
}

_BASE = WIDE_SQL + """,
ba AS (SELECT issuer, fiscal_year, revenue, least(0.35, ebit / revenue / 4)::DOUBLE * 0.76::DOUBLE AS margin, 0.03::DOUBLE + 0.01::DOUBLE * (issuer % 6) AS growth, coalesce(cash, 0) AS cash FROM wide WHERE revenue > 0 AND ebit > 0)"""


def _economic_sql(variants: str) -> str:
    """``ec(issuer, fiscal_year, k, pv, terminal)`` for ``variants``: k, growth, target, roiic, cap and fade beside the columns of ``ba``."""
    phase = lambda ahead, steady: f"CASE WHEN t <= cap THEN {ahead} WHEN fade > 0 AND t <= cap + fade THEN {ahead} + ({steady} - {ahead}) * (t - cap) / fade ELSE {steady} END"
    target = f"(margin + (target - margin) * least(t / {CONVERGE}, 1.0))"
    return _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
va AS ({variants}),
st AS (SELECT va.*, 0 AS t, revenue AS rev, revenue * margin AS nopat, 0.0::DOUBLE AS pv FROM va
  UNION ALL SELECT issuer, fiscal_year, revenue, margin, cash, k, growth, target, roiic, cap, fade, t, rev2, rev2 * m2, pv + (rev2 * m2 - greatest(rev2 * m2 - nopat, 0) / r2) / pow(1.105, t) FROM (
    SELECT *, rev * (1 + ({phase('growth', '0.02')})) AS rev2, ({phase(target, 'margin')}) AS m2, ({phase('roiic', '0.105')}) AS r2 FROM (SELECT * REPLACE (t + 1 AS t) FROM st WHERE t < {YEARS}))),
ec AS (SELECT *, rev * 1.02 * margin * (1 - 0.02::DOUBLE / 0.105) / 0.085 / pow(1.105, 10) AS terminal FROM st WHERE t = {YEARS})"""


_VARIANT = "SELECT issuer, fiscal_year, revenue, margin, cash, {k} AS k, {growth}::DOUBLE AS growth, {target}::DOUBLE AS target, {roiic}::DOUBLE AS roiic, {cap} AS cap, {fade} AS fade FROM ba"


def _variants(*changes: dict) -> str:
    usual = {"growth": "growth", "target": "margin * 1.1", "roiic": "0.15", "cap": CAP, "fade": FADE}
    return " UNION ALL ".join(_VARIANT.format(**(usual | c | {"k": k})) for k, c in enumerate(changes))


_SURFACE = WIDE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
gp AS (SELECT g::DOUBLE AS growth, m::DOUBLE AS margin, r::DOUBLE AS roiic, c::INTEGER AS cap FROM unnest([-0.05, 0.0, 0.05, 0.10, 0.15]) AS a(g), unnest([0.03, 0.06, 0.09, 0.12, 0.15]) AS b(m), unnest([0.08, 0.12, 0.16]) AS d(r), unnest([0, 3, 5, 8]) AS e(c)),
gs AS (SELECT *, 0 AS t, 1.0::DOUBLE AS rev, 0.0::DOUBLE AS pv FROM gp
  UNION ALL SELECT growth, margin, roiic, cap, t, rev2, pv + (rev2 * margin - greatest(rev2 * margin - rev * margin, 0) / CASE WHEN t <= cap THEN roiic ELSE 0.105 END) / pow(1.105, t)
  FROM (SELECT *, rev * (1 + CASE WHEN t <= cap THEN growth ELSE 0.02 END) AS rev2 FROM (SELECT * REPLACE (t + 1 AS t) FROM gs WHERE t < 10))),
gv AS (SELECT growth, margin, roiic, cap, pv + rev * 1.02 * margin * (1 - 0.02::DOUBLE / 0.105) / 0.085 / pow(1.105, 10) AS v FROM gs WHERE t = 10),
sp AS (SELECT issuer, fiscal_year, growth, margin, roiic, cap, v, cash / revenue AS target, round(abs(v / (cash / revenue) - 1), 9) AS error FROM wide, gv WHERE revenue > 0 AND cash > 0)"""
_LEVELS = _SURFACE.replace(_SURFACE[_SURFACE.index("gp AS ("):_SURFACE.index("gs AS (")], """gp AS (SELECT g::DOUBLE AS growth, m::DOUBLE AS margin, r::DOUBLE AS roiic, c::INTEGER AS cap FROM unnest([-0.20, 0.00, 0.10, 0.25, 0.60]) AS a(g), unnest([-0.20, 0.05, 0.15, 0.30, 0.60]) AS b(m), unnest([0.03, 0.10, 0.25, 0.75, 2.00]) AS d(r), unnest([1, 5, 10, 20, 40]) AS e(c)),
""")
_SCORED = """
WITH k AS (SELECT c_custkey, c_nationkey, c_custkey AS c, (50 + (c_custkey * 7) % 101)::DOUBLE AS base FROM customer),
sc AS (SELECT *, (c * 3 % 101)::DOUBLE AS gap, (c * 5 % 101)::DOUBLE AS probable, (c * 11 % 101)::DOUBLE AS plausible, (c * 13 % 101)::DOUBLE AS probable_revision, (c * 17 % 101)::DOUBLE AS plausible_revision, (c * 19 % 101)::DOUBLE AS breadth,
  CASE WHEN c % 10 <> 0 THEN (c * 23 % 101)::DOUBLE END AS evidence_revision, base - c * 29 % 101 AS down, base + c * 31 % 101 AS up, CASE WHEN c % 7 <> 0 THEN (c * 37 % 101)::DOUBLE / 100 END AS confidence, c % 6 AS warnings,
  c % 9 <> 0 AS applicable, c % 4 AS counter, c % 5 AS wideners, c % 12 <> 0 AS possible FROM k),
fr AS (SELECT *, greatest(0, least(100, 0.35::DOUBLE * least(100, 100 * greatest(0, base - down) / abs(base)) + 0.35::DOUBLE * least(100, 50 * abs(up - down) / abs(base)) + 0.20::DOUBLE * coalesce(100 * (1 - confidence), 100) + 0.10::DOUBLE * least(100, 20 * warnings))) AS fragility FROM sc)"""
_OVERLAY = _SCORED + """,
ov AS (SELECT c_custkey, possible, CASE WHEN confidence IS NOT NULL THEN fragility END AS f, c % 5 <> 3 AS known, counter, wideners FROM fr),
fl AS (SELECT *, coalesce(f >= 70, false) AS high, known AND (counter >= 2 OR wideners >= 3) AS severe FROM ov),
dc AS (SELECT c_custkey, CASE WHEN NOT possible OR (high AND severe) THEN 'EXCLUDED' WHEN high OR severe OR f IS NULL THEN 'POSITION_CAP' ELSE 'ELIGIBLE' END AS decision,
  CASE WHEN NOT possible THEN 'THREE_P_POSSIBLE_FAIL' ELSE concat_ws(',', CASE WHEN f IS NULL THEN 'FRAGILITY_MISSING' WHEN high THEN 'HIGH_FRAGILITY' END, CASE WHEN NOT known THEN 'INDUSTRY_CONTEXT_MISSING' WHEN severe THEN 'SEVERE_INDUSTRY_RISK' END) END AS reasons FROM fl)"""
_GAPS = _SCORED + """,
gd AS (SELECT c_custkey, c_nationkey, possible, base, down, up, round((up + down) / 2 / base - 1, 9) AS central,
  ((gap > probable + 15)::INTEGER + (plausible > breadth + 15)::INTEGER + (probable_revision > gap + 15)::INTEGER + (breadth > plausible_revision + 15)::INTEGER)::BIGINT AS favorable,
  ((gap + 20 < probable)::INTEGER + (plausible + 20 < breadth)::INTEGER + (probable_revision + 20 < gap)::INTEGER + (breadth + 20 < plausible_revision)::INTEGER)::BIGINT AS adverse FROM fr),
dr AS (SELECT *, CASE WHEN NOT possible THEN 'INDETERMINATE' WHEN central > 0 AND adverse = 0 THEN 'FAVORABLE' WHEN central < 0 OR adverse > favorable THEN 'UNFAVORABLE' ELSE 'OVERLAP' END AS direction FROM gd)"""


def _rim_sql(table_: str, book: str, roe: str, ke: str) -> str:
    """A subquery's value by residual income over five years."""
    steps, prior = "", f"SELECT *, {book} AS b0, 0.0::DOUBLE AS pv0, {roe} AS roe, {ke}::DOUBLE AS ke, {ke} + 0.25 * ({roe} - {ke}) AS rt FROM {table_}"
    for t in range(1, 6):
        steps = f"SELECT *, b{t - 1} * (1 + (roe + (rt - roe) * {t - 1} / 4) * 0.6) AS b{t}, pv{t - 1} + b{t - 1} * (roe + (rt - roe) * {t - 1} / 4 - ke) / pow(1 + ke, {t}) AS pv{t} FROM ({prior})"
        prior = steps
    return f"SELECT *, b0 + pv5 + b5 * 1.02 * (rt - ke) / (ke - 0.02) / pow(1 + ke, 5) AS rim FROM ({prior})"


ORACLE_SQL = {
    "economic_dcf": _economic_sql(_variants({}, {"cap": 0, "fade": 0})) + """,
ad AS (SELECT issuer, fiscal_year, any_value(cash) AS cash, any_value(revenue * margin / 0.105 * 0.95 + revenue * 0.1 * 0.05) AS in_place, max(CASE WHEN k = 0 THEN (pv + terminal) * 0.95 + revenue * 0.1 * 0.05 END) AS ev,
  max(CASE WHEN k = 1 THEN (pv + terminal) * 0.95 + revenue * 0.1 * 0.05 END) AS steady, max(CASE WHEN k = 0 THEN terminal / (pv + terminal) END) AS share FROM ec GROUP BY 1, 2)
SELECT issuer, fiscal_year, round(ev, 2) AS ev, round(ev - steady, 2) AS cap_value, round(ev - in_place, 2) AS pvgo, round(share, 6) AS terminal_share, round((ev + cash) / 100, 4) AS per_share,
  concat_ws(',', CASE WHEN ev <= 0 THEN 'NON_POSITIVE_ENTERPRISE_VALUE' END, CASE WHEN ev + cash <= 0 THEN 'NON_POSITIVE_EQUITY_VALUE' END, CASE WHEN share < 0 OR share > 0.90 THEN 'UNRELIABLE_TERMINAL_VALUE_SHARE' END) AS reasons FROM ad""",
    "scenario_range": _economic_sql(_variants({"growth": "growth - 0.02", "target": "margin * 1.0"}, {}, {"growth": "growth + 0.02", "target": "margin * 1.2"})) + """,
vs AS (SELECT issuer, fiscal_year, k, (((pv + terminal) * 0.95 + revenue * 0.1 * 0.05) + cash) / 100 AS v FROM ec),
pw AS (SELECT issuer, fiscal_year, max(v) FILTER (WHERE k = 0) AS downside, max(v) FILTER (WHERE k = 1) AS central, max(v) FILTER (WHERE k = 2) AS upside FROM vs GROUP BY 1, 2)
SELECT issuer, fiscal_year, round(downside, 4) AS downside, round(central, 4) AS central, round(upside, 4) AS upside, downside <= central AND central <= upside AS ordered,
  round(greatest(0, central - (central - least(downside, central, upside)) * 1.2), 4) AS low, round(central + (greatest(downside, central, upside) - central) * 1.2, 4) AS high FROM pw""",
    "apv_value": _BASE + """,
ap AS (SELECT issuer, fiscal_year, revenue, cash, list_sum([revenue * margin * 0.6 * pow(1 + growth, t) / pow(1.105, t) FOR t IN range(1, 6)]) + revenue * margin * 0.6 * pow(1 + growth, 5) * 1.02 / 0.085 / pow(1.105, 5)
  + list_sum([revenue * 0.3 * 0.05 * 0.24 / t / pow(1.06, t) FOR t IN range(1, 6)]) - revenue * 0.01 AS v FROM ba)
SELECT issuer, fiscal_year, round(v, 2) AS enterprise, round(v + cash - 0.3 * revenue, 2) AS equity, round((v + cash - 0.3 * revenue) / 100, 4) AS per_share FROM ap""",
    "sotp_value": """
WITH p AS (SELECT o_custkey AS issuer, substr(o_orderpriority, 1, 1)::INTEGER AS r, sum(o_totalprice::DECIMAL(14,2))::DECIMAL(18,2) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT issuer, count(*) AS parts, sum(v * (CASE WHEN r <= 2 THEN 0.85 ELSE 1 END)::DECIMAL(3,2) * (CASE WHEN r = 5 THEN 1.0 ELSE 0.5 + 0.1 * r END)::DECIMAL(3,2)) + 1000 * sum(n) - sum(v) * 0.05::DECIMAL(3,2) AS e FROM p GROUP BY 1)
SELECT issuer, parts, round(e, 2)::DOUBLE AS equity, round(e::DOUBLE / 100, 3) AS per_share FROM s""",
    "dcf_confidence": "SELECT c_custkey, round(list_sum([[1.0, 0.95, 0.75, 0.70, 0.55, 0.25, 0.10][(c_custkey * (i + 3)) % 7 + 1]::DOUBLE FOR i IN range(1, 12)]) / 11, 6) AS confidence FROM customer",
    "rim_cases": _BASE + """,
sz AS (SELECT ba.*, ['LARGE', 'MID', 'SMALL'][issuer % 3 + 1] AS size, [0.09, 0.10, 0.12][issuer % 3 + 1]::DOUBLE AS k FROM ba)
SELECT issuer, fiscal_year, any_value(size) AS size, round(max(rim) FILTER (WHERE step = -1), 2) AS downside, round(max(rim) FILTER (WHERE step = 0), 2) AS central, round(max(rim) FILTER (WHERE step = 1), 2) AS upside FROM (""" + _rim_sql("(SELECT * FROM sz, unnest([-1, 0, 1]) AS u(step))", "revenue / 2", "(margin + step * 0.03)", "k") + ") GROUP BY 1, 2",
    "normalized_fcff": WIDE_SQL + """,
l AS (SELECT *, lag(revenue) OVER (PARTITION BY issuer ORDER BY fiscal_year) AS before FROM wide WHERE revenue > 0 AND ebit IS NOT NULL),
m AS (SELECT issuer, fiscal_year, revenue, greatest(-0.10, least(0.15, revenue / before - 1))::DOUBLE AS g, greatest(-0.20, least(0.35, ebit / revenue / 4 * 0.76))::DOUBLE AS m FROM l WHERE before > 0),
q AS (SELECT issuer, count(*) AS years, arg_max(revenue, fiscal_year) AS revenue, quantile_cont(g, [0.25, 0.5, 0.75]) AS g, quantile_cont(m, [0.25, 0.5, 0.75]) AS m FROM m GROUP BY 1),
c AS (SELECT issuer, years, revenue, g[k + 1] AS g, m[k + 1] AS m, 0.105::DOUBLE + 0.015 * (1 - k) AS w FROM q, range(0, 3) AS r(k)),
v AS (SELECT issuer, years, round(list_sum([revenue * pow(1 + g, t) * m / pow(1 + w, t) FOR t IN range(1, 6)]) + revenue * pow(1 + g, 5) * m * 1.02 / (w - 0.02) / pow(1 + w, 5), 2) AS v FROM c),
a AS (SELECT issuer, years, list(v ORDER BY v) AS v FROM v GROUP BY 1, 2)
SELECT issuer, years, v[1] AS downside, v[2] AS central, v[3] AS upside FROM a""",
    "implied_driver_root": _economic_sql(_variants(*({"growth": f"{g}"} for g in GROWTH_GRID))) + """,
pt AS (SELECT issuer, fiscal_year, 0.03::DOUBLE + 0.01::DOUBLE * (issuer % 6) AS own, k, growth AS x, round((pv + terminal) / revenue, 9) AS y FROM ec),
nx AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(y) OVER (PARTITION BY issuer, fiscal_year) AS top FROM pt WINDOW w AS (PARTITION BY issuer, fiscal_year ORDER BY k)),
rt AS (SELECT issuer, fiscal_year, own, top, CASE WHEN x2 IS NOT NULL AND (y - 1.5) * (y2 - 1.5) <= 0 THEN x + coalesce((1.5 - y) * (x2 - x) / nullif(y2 - y, 0), 0) END AS root, round(abs((x + x2) / 2 - own), 9) AS far, x FROM nx),
bs AS (SELECT issuer, fiscal_year, any_value(own) AS own, any_value(top) AS top, arg_min(root, (far, x)) FILTER (WHERE root IS NOT NULL) AS root FROM rt GROUP BY 1, 2)
SELECT issuer, fiscal_year, CASE WHEN root IS NOT NULL THEN 'SOLVED' WHEN top < 1.5 THEN 'CENSORED_HIGH' ELSE 'CENSORED_LOW' END AS status, round(root, 6) AS implied, round(root - own, 6) AS gap FROM bs""",
    "implied_ranges_4d": _SURFACE + """,
rk AS (SELECT *, count(*) FILTER (WHERE error <= 0.03) OVER (PARTITION BY issuer, fiscal_year) AS within, row_number() OVER (PARTITION BY issuer, fiscal_year ORDER BY error, cap, growth, margin, roiic) AS r FROM sp),
ch AS (SELECT * FROM rk WHERE CASE WHEN within > 0 THEN error <= 0.03 ELSE r <= 12 END)
SELECT issuer, fiscal_year, max(within) AS within, count(*) AS solutions, min(growth) AS growth_low, max(growth) AS growth_high, min(margin) AS margin_low, max(margin) AS margin_high, min(roiic) AS roiic_low, max(roiic) AS roiic_high,
  min(cap)::DOUBLE AS cap_low, max(cap)::DOUBLE AS cap_high FROM ch GROUP BY 1, 2""",
    "expectation_surface_kernel": _LEVELS + """,
ws AS (SELECT *, exp(-0.5 * pow(ln(v / target) / 0.05, 2)) AS w FROM sp WHERE v > 0),
su AS (SELECT issuer, fiscal_year, sum(w) AS w1, sum(w * w) AS w2, min(error) AS best, """ + ", ".join(f"sum(w * {n}) AS m_{n}" for n in LEVELS) + """ FROM ws GROUP BY 1, 2),
""" + ",\n".join(f"""c_{n} AS (SELECT issuer, fiscal_year, {n} AS x, sum(sum(w)) OVER (PARTITION BY issuer, fiscal_year ORDER BY {n}) / sum(sum(w)) OVER (PARTITION BY issuer, fiscal_year) AS c FROM ws GROUP BY 1, 2, 3),
q_{n} AS (SELECT issuer, fiscal_year, min(x) FILTER (WHERE round(c, 9) >= 0.1) AS lo, min(x) FILTER (WHERE round(c, 9) >= 0.9) AS hi FROM c_{n} GROUP BY 1, 2)""" for n in LEVELS) + """
SELECT issuer, fiscal_year, round(CASE WHEN w1 > 1e-12 THEN w1 * w1 / w2 END, 4) AS effective_points,
""" + ",\n".join(f"  CASE WHEN w1 > 1e-12 THEN round(m_{n} / w1, 6) END AS {n}, CASE WHEN w1 > 1e-12 THEN q_{n}.lo::DOUBLE END AS {n}_p10, CASE WHEN w1 > 1e-12 THEN q_{n}.hi::DOUBLE END AS {n}_p90" for n in LEVELS) + """,
  best <= 0.10 AND coalesce(CASE WHEN w1 > 1e-12 THEN w1 * w1 / w2 END, 0) >= 5 AS eligible FROM su """ + " ".join(f"JOIN q_{n} USING (issuer, fiscal_year)" for n in LEVELS),
    "driver_sensitivities": _economic_sql(_variants({}, {"growth": "growth + 0.01"}, {"target": "margin * 1.2"}, {"roiic": "0.18"}, {"cap": CAP + 2})) + """,
pw AS (SELECT issuer, fiscal_year, max(pv + terminal) FILTER (WHERE k = 0) AS b, max(pv + terminal) FILTER (WHERE k = 1) AS g, max(pv + terminal) FILTER (WHERE k = 2) AS m, max(pv + terminal) FILTER (WHERE k = 3) AS r, max(pv + terminal) FILTER (WHERE k = 4) AS c FROM ec GROUP BY 1, 2),
dv AS (SELECT issuer, fiscal_year, round(g / b - 1, 8) AS g, round(m / b - 1, 8) AS m, round(r / b - 1, 8) AS r, round(c / b - 1, 8) AS c FROM pw)
SELECT issuer, fiscal_year, round(g, 6) AS growth, round(m, 6) AS margin, round(r, 6) AS roiic, round(c, 6) AS cap,
  list_sort([{'s': abs(g), 'd': 'GROWTH'}, {'s': abs(m), 'd': 'MARGIN'}, {'s': abs(r), 'd': 'ROIIC'}, {'s': abs(c), 'd': 'CAP'}])[4].d AS turbo FROM dv""",
    "fragility_score": _SCORED + "\nSELECT c_custkey, round(fragility, 6) AS fragility FROM fr",
    "three_axis_score": _SCORED + """,
ax AS (SELECT c_custkey, applicable, 0.50::DOUBLE * gap + 0.30::DOUBLE * probable + 0.20::DOUBLE * plausible AS cheap, greatest(0, least(100, 100 - fragility)) AS sturdy,
  CASE WHEN applicable THEN 0.35::DOUBLE * probable_revision + 0.25::DOUBLE * plausible_revision + 0.25::DOUBLE * breadth + 0.15::DOUBLE * evidence_revision END AS improving FROM fr)
SELECT c_custkey, round(cheap, 6) AS cheap, round(improving, 6) AS improving, round(sturdy, 6) AS sturdy,
  CASE WHEN improving IS NOT NULL THEN CASE WHEN cheap = 0 OR improving = 0 OR sturdy = 0 THEN 0 ELSE round(100 * pow(cheap / 100, 0.40) * pow(improving / 100, 0.35) * pow(sturdy / 100, 0.25), 6) END END AS composite,
  CASE WHEN NOT applicable THEN 'MODEL_NOT_APPLICABLE' WHEN improving IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN sturdy < 30 THEN 'HIGH_FRAGILITY' ELSE 'VALID' END AS status FROM ax""",
    "risk_overlay": _OVERLAY + "\nSELECT c_custkey, decision, CASE decision WHEN 'EXCLUDED' THEN 0.0 WHEN 'POSITION_CAP' THEN 0.5 ELSE 1.0 END::DOUBLE AS multiplier, reasons FROM dc",
    "reason_code_explode": _OVERLAY + "\nSELECT decision, reason, count(*) AS n FROM (SELECT decision, unnest(string_split(reasons, ',')) AS reason FROM dc) WHERE reason <> '' GROUP BY 1, 2",
    "expectation_gap_direction": _GAPS + "\nSELECT c_custkey, round(central, 6) AS central, favorable, adverse, direction FROM dr",
    "opportunity_rank": _GAPS + """,
ms AS (SELECT c_nationkey, c_custkey, direction, round(central, 6) AS central, round(down / base - 1, 6) AS downside, round((up - down) / base, 6) AS width FROM dr)
SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY central DESC, downside DESC, width, c_custkey)::INTEGER AS rank, c_custkey, central, downside, width FROM ms WHERE direction = 'FAVORABLE' AND central >= 0 AND downside >= -0.30 AND width <= 3.0""",
    "value_rank_lexicographic": """
WITH r AS (SELECT c_custkey, c_mktsegment, c_custkey % 11 AS score, round(0.3::DOUBLE + (c_custkey * 37 % 100) / 100, 4) AS p, c_custkey % 10 / 10 AS confidence, c_custkey % 7 / 7 AS coverage, CASE WHEN c_custkey % 211 <> 0 THEN c_custkey END AS c FROM customer),
f AS (SELECT *, round(1 - p, 4) AS margin, bool_and(c IS NOT NULL) OVER (PARTITION BY c_mktsegment, score) AS whole FROM r WHERE score >= 5 AND 1 - p >= 0.20::DOUBLE AND confidence >= 0.5 AND coverage >= 0.5),
k AS (SELECT *, CASE WHEN whole THEN [score, c * 3 % 5, c * 5 % 4, c * 7 % 3, -(c * 11 % 6)] ELSE [score, 0, 0, 0, 0] END AS k FROM f),
s AS (SELECT *, (rank() OVER (PARTITION BY c_mktsegment ORDER BY k) + (count(*) OVER (PARTITION BY c_mktsegment, k) - 1) / 2) / count(*) OVER (PARTITION BY c_mktsegment) AS quality,
  (rank() OVER (PARTITION BY c_mktsegment ORDER BY margin) + (count(*) OVER (PARTITION BY c_mktsegment, margin) - 1) / 2) / count(*) OVER (PARTITION BY c_mktsegment) AS value FROM k),
b AS (SELECT *, round(0.5 * quality + 0.5 * value, 9) AS blend FROM s)
SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY blend DESC, p, c_custkey)::INTEGER AS rank, c_custkey, round(quality, 6) AS quality, round(value, 6) AS value, round(blend, 6) AS blend FROM b""",
    "value_yields": WIDE_SQL + """,
p AS (SELECT *, revenue * (1 + issuer % 5) AS price, revenue * (1 + issuer % 5) - coalesce(cash, 0) AS ev FROM wide)
SELECT issuer, fiscal_year, round(CASE WHEN ebit > 0 AND price > 0 THEN ebit * 0.76 / price END, 6) AS earnings, round(CASE WHEN ebit * 0.76 - capex > 0 AND price > 0 THEN (ebit * 0.76 - capex) / price END, 6) AS free_cash,
  round(CASE WHEN revenue > 0 AND price > 0 THEN revenue / price END, 6) AS sales, round(CASE WHEN ebit > 0 AND ev > 0 THEN ebit / ev END, 6) AS ebit_to_ev,
  round(CASE WHEN ebit + 0.03 * revenue > 0 AND ev > 0 THEN (ebit + 0.03 * revenue) / ev END, 6) AS ebitda_to_ev, round(CASE WHEN cash > 0 AND price > 0 THEN cash / price END, 6) AS cash_to_price FROM p""",
    "quality_factor": WIDE_SQL + """
SELECT issuer, fiscal_year, round(ebit / (revenue + cash) + (ebit - capex) / (revenue + cash) - 0.3 * revenue / (revenue + cash), 6) AS quality FROM wide WHERE revenue + cash > 0""",
    "value_factor_vector": WIDE_SQL + """,
l AS (SELECT issuer, fiscal_year, revenue, ebit, ebit / revenue AS m FROM wide WHERE revenue > 0 AND ebit IS NOT NULL)
SELECT a.issuer, a.fiscal_year, round(a.revenue / b.revenue - 1, 6) AS growth, round(a.revenue / b.revenue - 1 - (b.revenue / c.revenue - 1), 6) AS acceleration, round(a.m - b.m, 6) AS margin_change,
  round((a.ebit / nullif(b.ebit, 0) - 1) / nullif(round(a.revenue / b.revenue - 1, 9), 0), 4) AS leverage
FROM l a JOIN l b ON a.issuer = b.issuer AND b.fiscal_year = a.fiscal_year - 1 JOIN l c ON a.issuer = c.issuer AND c.fiscal_year = a.fiscal_year - 2""",
    "supported_drivers": WIDE_SQL + """,
l AS (SELECT issuer, fiscal_year, revenue / lag(revenue) OVER (PARTITION BY issuer ORDER BY fiscal_year) - 1 AS g, ebit / revenue / 4 * 0.76 AS m, round(ebit / revenue / 4 * 0.76 / 0.8, 9) AS roic, row_number() OVER (PARTITION BY issuer ORDER BY fiscal_year DESC) AS r FROM wide WHERE revenue > 0 AND ebit IS NOT NULL),
f AS (SELECT issuer, max(fiscal_year) FILTER (WHERE roic <= 0.105) AS failed FROM l GROUP BY 1),
a AS (SELECT issuer, count(*) AS years, median(g) FILTER (WHERE r <= 3) AS g, median(m) FILTER (WHERE r <= 3) AS m, arg_max(roic, fiscal_year) AS roic, count(*) FILTER (WHERE failed IS NULL OR fiscal_year > failed) AS streak FROM l JOIN f USING (issuer) GROUP BY 1)
SELECT issuer, years, CASE WHEN g IS NOT NULL THEN round(greatest(-0.10, least(0.15, g)), 6)::DOUBLE END AS growth, round(greatest(-0.20, least(0.35, m)), 6)::DOUBLE AS margin, streak, round(greatest(3, least(15, 3 + 20 * greatest(0, roic - 0.105) + least(streak, 3))))::BIGINT AS cap FROM a""",
    "routed_valuation": WIDE_SQL + """,
r AS (SELECT *, CASE WHEN revenue IS NULL THEN 'NAV' WHEN ebit IS NULL THEN 'SALES' ELSE 'RIM' END AS method, greatest(-0.2, least(0.35, ebit / revenue / 4))::DOUBLE AS mg FROM wide),
v AS (SELECT issuer, fiscal_year, method, CASE method WHEN 'RIM' THEN CASE WHEN revenue > 0 THEN rim END WHEN 'SALES' THEN revenue * 1.6 ELSE cash * 0.8 END AS value FROM (""" + _rim_sql("r", "revenue / 2", "mg", "0.1") + """))
SELECT issuer, fiscal_year, method, round(value, 2) AS value, CASE WHEN value IS NULL THEN 'INSUFFICIENT_DATA' WHEN value <= 0 THEN 'NON_POSITIVE_VALUE' ELSE 'EXECUTED' END AS status FROM v""",
}
