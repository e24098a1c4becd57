"""What prices imply of each of four drivers, and how that moves while everything else is frozen."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import valuation as V
from tidemark.plans import kernels
from tidemark.shipping import ship_package

#: The states of each driver at which an issuer is valued; an advantage lasts no longer than the forecast.
GRIDS = {
    "GROWTH": (-0.50, -0.30, -0.20, -0.10, -0.05, 0.00, 0.02, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30, 0.40, 0.60, 0.80, 1.00),
    "MARGIN": (-0.50, -0.30, -0.20, -0.10, 0.00, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.60, 0.80, 0.90),
    "ROIIC": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30, 0.50, 0.75, 1.00, 2.00, 3.00, 4.00, 5.00),
    "CAP": tuple(float(k) for k in range(kernels.YEARS + 1)),
}
#: Prices in multiples of cash.
MULTIPLE = 3.0


def _values(revenue: pd.Series, margin: pd.Series, growth: pd.Series) -> pd.Series:
    """Values at all states of the drivers, in the order of ``GRIDS``, for each row."""
    r, m, g = (c.to_numpy() for c in (revenue, margin, growth))
    usual = {"revenue": r, "nopat": r * m, "margin": m, "stable_margin": m, "growth": g, "target": m * 1.1, "roiic": 0.15, "wacc": kernels.WACC, "stable_growth": kernels.STABLE_GROWTH, "stable_roic": kernels.WACC}
    named, out = {"GROWTH": "growth", "MARGIN": "target", "ROIIC": "roiic"}, []
    for driver, grid in GRIDS.items():
        for x in grid:
            assumed = usual | {named[driver]: x} if driver in named else usual
            out.append(V.economic_values(assumed, kernels.YEARS, int(x) if driver == "CAP" else kernels.CAP, kernels.FADE, kernels.CONVERGE))
    return pd.Series(list(np.stack(out, axis=1)))


def _curves(spark, sf_dir: str) -> DataFrame:
    """``(issuer, fiscal_year, driver, points, supported, entry, target)``: values over revenue along each driver, and prices of this year and the next."""
    ship_package(spark)
    later = Window.partitionBy("issuer").orderBy("fiscal_year")
    base = kernels._base(spark, sf_dir).withColumns({"next_cash": F.lead("cash").over(later), "next_year": F.lead("fiscal_year").over(later)})
    priced = base.filter("next_year = fiscal_year + 1").withColumns({"entry": F.round(MULTIPLE * F.col("cash") / F.col("revenue"), 9), "target": F.round(MULTIPLE * F.col("next_cash") / F.col("revenue"), 9)})
    # few bytes to an issuer's year, but some 60 valuations: as many tasks as shuffles have
    dealt = priced.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "issuer", "fiscal_year")
    values = F.pandas_udf(_values, "array<double>")("revenue", "margin", "growth").alias("v")
    own = {"GROWTH": F.col("growth"), "MARGIN": F.col("margin") * 1.1, "ROIIC": F.lit(0.15), "CAP": F.lit(float(kernels.CAP))}
    curves, at = [], 0
    for driver, grid in GRIDS.items():
        xs = F.array(*map(F.lit, grid))
        points = F.zip_with(xs, F.slice("v", at + 1, len(grid)), lambda x, v: F.struct(x.alias("x"), F.round(v / F.col("revenue"), 9).alias("y")))
        curves.append(F.struct(F.lit(driver).alias("driver"), points.alias("points"), own[driver].alias("supported")))
        at += len(grid)
    valued = dealt.select("issuer", "fiscal_year", "revenue", "margin", "growth", "entry", "target", values)
    return valued.select("issuer", "fiscal_year", F.inline(F.array(*curves)), "entry", "target")


def revisions(spark, sf_dir: str) -> DataFrame:
    """How each driver's implied value moves from one year's price to the next on a frozen curve."""
    out = V.frozen_revision(_curves(spark, sf_dir), "points", "supported", "entry", "target")
    shown = {"entry_implied": "entry_root.x", "entry_low": "entry_root.low", "entry_high": "entry_root.high", "target_implied": "target_root.x", "revision": "revision"}
    return out.select("issuer", "fiscal_year", "driver", "status", *(F.round(c, 6).alias(a) for a, c in shown.items()))


QUERIES = {"frozen_curve_revision": revisions}


def _grid_sql() -> str:
    usual = {"growth": "growth", "target": "margin * 1.1", "roiic": "0.15", "cap": str(kernels.CAP), "fade": str(kernels.FADE)}
    named = {"GROWTH": "growth", "MARGIN": "target", "ROIIC": "roiic", "CAP": "cap"}
    k, out = 0, []
    for driver, grid in GRIDS.items():
        for x in grid:
            changed = usual | {named[driver]: repr(x) if driver != "CAP" else str(int(x))}
            out.append(kernels._VARIANT.format(k=k, **changed))
            k += 1
    return " UNION ALL ".join(out)


def _states_sql() -> str:
    rows = [(d, x) for d, grid in GRIDS.items() for x in grid]
    return "gr AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{d}', {x!r}::DOUBLE)" for k, (d, x) in enumerate(rows)) + ") AS v(k, driver, x))"


ORACLE_SQL = {
    "frozen_curve_revision": kernels._economic_sql(_grid_sql()) + ",\n" + _states_sql() + """,
pr AS (SELECT * FROM (SELECT issuer, fiscal_year, margin, growth, round(3.0::DOUBLE * cash / revenue, 9) AS entry, round(3.0::DOUBLE * lead(cash) OVER w / revenue, 9) AS target, lead(fiscal_year) OVER w AS later FROM ba WINDOW w AS (PARTITION BY issuer ORDER BY fiscal_year)) WHERE later = fiscal_year + 1),
cv AS (SELECT ec.issuer, ec.fiscal_year, driver, x, round((pv + terminal) / revenue, 9) AS y, pr.entry, pr.target AS target, CASE driver WHEN 'GROWTH' THEN pr.growth WHEN 'MARGIN' THEN pr.margin * 1.1 WHEN 'ROIIC' THEN 0.15 ELSE 5 END AS own
  FROM ec JOIN gr USING (k) JOIN pr ON ec.issuer = pr.issuer AND ec.fiscal_year = pr.fiscal_year),
sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM cv WINDOW w AS (PARTITION BY issuer, fiscal_year, driver ORDER BY x)),
er AS (SELECT issuer, fiscal_year, driver, own, target, x AS low, CASE WHEN y = entry THEN x ELSE x2 END AS high, CASE WHEN y = entry THEN x ELSE x + coalesce((entry - y) * (x2 - x) / nullif(y2 - y, 0), 0) END AS root FROM sg WHERE y = entry OR (y - entry) * (y2 - entry) <= 0),
en AS (SELECT issuer, fiscal_year, driver, root, low, high FROM er QUALIFY row_number() OVER (PARTITION BY issuer, fiscal_year, driver ORDER BY round(abs(root - own), 9), low) = 1),
tr AS (SELECT issuer, fiscal_year, driver, x AS low, CASE WHEN y = target THEN x ELSE x + coalesce((target - y) * (x2 - x) / nullif(y2 - y, 0), 0) END AS root FROM sg WHERE y = target OR (y - target) * (y2 - target) <= 0),
tn AS (SELECT tr.issuer, tr.fiscal_year, tr.driver, tr.root FROM tr JOIN en USING (issuer, fiscal_year, driver) QUALIFY row_number() OVER (PARTITION BY tr.issuer, tr.fiscal_year, tr.driver ORDER BY round(abs(tr.root - en.root), 9), tr.low) = 1)
SELECT issuer, fiscal_year, driver, CASE WHEN en.root IS NULL THEN 'ENTRY_PRICE_OUTSIDE_CURVE' WHEN tn.root IS NULL THEN 'TARGET_PRICE_OUTSIDE_CURVE' ELSE 'SOLVED' END AS status,
  round(en.root, 6) AS entry_implied, round(en.low, 6) AS entry_low, round(en.high, 6) AS entry_high, round(tn.root, 6) AS target_implied, round(tn.root - en.root, 6) AS revision
FROM (SELECT DISTINCT issuer, fiscal_year, driver FROM cv) LEFT JOIN en USING (issuer, fiscal_year, driver) LEFT JOIN tn USING (issuer, fiscal_year, driver)""",
}
