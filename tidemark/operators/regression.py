"""Least squares with controls and a constant for each period, from sums of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize, release, sized


RESULT = "n long, units long, periods long, coefficient double, se double, t double, r_squared double"


def panel_regression(rows: DataFrame, y: str, x: str, controls: list[str], unit: str, period: str) -> DataFrame:
    """``panel_regressions`` with one set of controls: one row, without its name."""
    return panel_regressions(rows, y, x, {"": controls}, unit, period).drop("specification")


def panel_regressions(rows: DataFrame, y: str, x: str, specifications: dict[str, list[str]], unit: str, period: str) -> DataFrame:
    """A row for each of ``specifications``, lists of controls by name: ``n``, ``units``, ``periods``, ``coefficient`` of ``x``, its ``se`` clustered by unit and period, ``t`` and ``r_squared`` of ``x`` on the rest.

    Every period has a constant, which centring by period takes out exactly. One
    aggregation per period yields all sums of products; they add up to one
    matrix, the only thing solved outside Spark, by a pseudo-inverse, so that
    controls which others explain do no harm. A second pass needs the rest of
    ``x`` that controls leave and the residual; both are one weighted sum of a
    row's columns. The error is the sum over units and over periods less that
    over their cells. Rows with a null in any column are left out; with fewer
    than three rows, or two more than there are controls, only ``n`` is told.
    Specifications that leave out the same rows share both passes.
    """
    names = list(dict.fromkeys(c for controls in specifications.values() for c in controls))
    value = lambda c: F.col(c).cast("double")
    own = [F.when(~F.isnan(value(c)), value(c)).alias(f"_v{i + 2}") for i, c in enumerate(names)]
    some = rows.dropna(subset=[y, x, unit, period])
    held = materialize(some.select(F.col(unit).alias("_unit"), F.col(period).alias("_period"), value(y).alias("_v0"), value(x).alias("_v1"), *own), "panel")
    place = {c: i + 2 for i, c in enumerate(names)}
    gaps = held.agg(*(F.count_if(F.col(f"_v{i}").isNull()).alias(c) for c, i in place.items())).first() if names else {}
    alike: dict[frozenset, dict[str, list[int]]] = {}
    for name, controls in specifications.items():
        alike.setdefault(frozenset(place[c] for c in controls if gaps[c]), {})[name] = [place[c] for c in controls]
    found = {}
    for missing, specs in alike.items():
        found |= _fitted(held.dropna(subset=[f"_v{i}" for i in missing]) if missing else held, specs)
    release(held)
    return rows.sparkSession.createDataFrame([(name, *found[name]) for name in specifications], f"specification string, {RESULT}")


def _fitted(held: DataFrame, specs: dict[str, list[int]]) -> dict[str, tuple]:
    """``RESULT`` of each of ``specs``, lists of the numbers of their controls, over the same rows of ``_unit``, ``_period`` and ``_v`` columns."""
    used = [0, 1, *sorted({i for controls in specs.values() for i in controls})]
    pairs = [(i, j) for i in used for j in used if i <= j]
    products = [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_p{i}_{j}") for i, j in pairs]
    periods = materialize(held.groupBy("_period").agg(F.count("*").alias("_n"), *(F.avg(f"_v{i}").alias(f"_m{i}") for i in used), *products), "periods")
    centred = [F.sum(F.col(f"_p{i}_{j}") - F.col("_n") * F.col(f"_m{i}") * F.col(f"_m{j}")).alias(f"_p{i}_{j}") for i, j in pairs]
    total = periods.agg(F.sum("_n").alias("n"), F.count("*").alias("periods"), F.sum(F.col("_n") * F.col("_m1")).alias("_sum"), F.sum("_p1_1").alias("_square"), *centred).first()
    n, found, fits = total["n"] or 0, {}, {}
    for name, controls in specs.items():
        if n < max(3, len(controls) + 2):
            found[name] = (n, *[None] * 6)
            continue
        columns = [0, 1, *controls]
        gram = np.array([[total[f"_p{min(i, j)}_{max(i, j)}"] for j in columns] for i in columns])
        among = np.linalg.pinv(gram[2:, 2:], rcond=1e-12, hermitian=True) if controls else np.zeros((0, 0))
        # what is left of y and of x when the controls are taken out: weights of the centred columns
        left = [np.concatenate((np.eye(2)[i], -among @ gram[2:, i])) for i in (0, 1)]
        size = float(left[1] @ gram @ left[1])
        if size <= 1e-12 * max(gram[1, 1], 1e-300):
            found[name] = (n, None, total["periods"], *[None] * 4)
            continue
        slope = float(left[1] @ gram @ left[0]) / size
        fits[name] = (columns, left[1], left[0] - slope * left[1], size, slope)
    if fits:
        weighed = lambda columns, w: sum(((F.col(f"_v{i}") - F.col(f"_m{i}")) * F.lit(float(c)) for i, c in zip(columns, w, strict=True)), F.lit(0.0))
        scored = held.join(sized(periods).select("_period", *(f"_m{i}" for i in used)), "_period")
        us = [f"_u{k}" for k in range(len(fits))]
        scores = [F.sum(weighed(columns, rest) * weighed(columns, error)).alias(u) for u, (columns, rest, error, *_) in zip(us, fits.values(), strict=True)]
        cells = materialize(scored.groupBy("_unit", "_period").agg(*scores), "cells")
        squares = lambda sums: sums.agg(F.count("*").alias("n"), *(F.sum(F.col(u) * F.col(u)).alias(u) for u in us)).first()
        by_unit, by_period, by_cell = *(squares(cells.groupBy(c).agg(*(F.sum(u).alias(u) for u in us))) for c in ("_unit", "_period")), squares(cells)
        release(cells)
        for u, (name, (columns, _, _, size, slope)) in zip(us, fits.items(), strict=True):
            se = max(by_unit[u] + by_period[u] - by_cell[u], 0.0) ** 0.5 / size
            spread = total["_square"] - total["_sum"] ** 2 / n
            explained = 1 - size / spread if len(columns) > 2 and spread > 0 else None if len(columns) > 2 else 0.0
            found[name] = (n, by_unit["n"], total["periods"], slope, se, slope / se if se > 0 else None, explained)
    release(periods)
    return found
