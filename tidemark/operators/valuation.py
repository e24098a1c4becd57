"""Valuation kernels as column expressions: a row stays one row, whatever the years and scenarios."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def gordon(cash_flow: Column, rate: Column, growth: Column) -> Column:
    """Value of a growing perpetuity; null where the rate does not exceed the growth."""
    return F.when(rate > growth, cash_flow / (rate - growth))


def discounted(flows: Column, rate: Column) -> Column:
    """Present value of an array of flows at the ends of years 1, 2, ..."""
    paid = F.transform(flows, lambda x, i: x / F.pow(1 + rate, i + 1))
    return F.aggregate(paid, F.lit(0.0), lambda acc, x: acc + x)


def economic_core(a: Mapping[str, Column], years: int, cap: Column, fade: Column, converge: int) -> Column:
    """``struct<pv, terminal>`` of free cash flow whose growth, margin and returns fade from an advantage to a steady state.

    ``a`` names revenue, nopat, growth, margin, target, roiic, wacc, stable_growth, stable_margin and stable_roic.
    """
    start = F.struct(a["revenue"].alias("revenue"), a["nopat"].alias("nopat"), F.lit(0.0).alias("pv"))

    def year(acc: Column, t: Column) -> Column:
        target = lerp(a["margin"], a["target"], F.least(t / converge, F.lit(1.0)))
        faded = F.when(fade > 0, (t - cap) / F.when(fade > 0, fade))

        def phase(ahead: Column, steady: Column) -> Column:
            return F.when(t <= cap, ahead).when((fade > 0) & (t <= cap + fade), lerp(ahead, steady, faded)).otherwise(steady)

        revenue = acc["revenue"] * (1 + phase(a["growth"], a["stable_growth"]))
        nopat = revenue * phase(target, a["stable_margin"])
        free = nopat - F.greatest(nopat - acc["nopat"], F.lit(0.0)) / phase(a["roiic"], a["stable_roic"])
        return F.struct(revenue.alias("revenue"), nopat.alias("nopat"), (acc["pv"] + free / F.pow(1 + a["wacc"], t)).alias("pv"))

    def finish(acc: Column) -> Column:
        earned = acc["revenue"] * (1 + a["stable_growth"]) * a["stable_margin"] * (1 - a["stable_growth"] / a["stable_roic"])
        terminal = gordon(earned, a["wacc"], a["stable_growth"]) / F.pow(1 + a["wacc"], F.lit(years))
        return F.struct(acc["pv"].alias("pv"), terminal.alias("terminal"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year, finish)


def economic_values(a: Mapping[str, np.ndarray | float], years: int, cap: int, fade: int, converge: int) -> np.ndarray:
    """``pv + terminal`` of ``economic_core`` on arrays, step by step the same."""
    revenue, nopat, pv = a["revenue"], a["nopat"], 0.0
    for t in range(1, years + 1):
        target = a["margin"] + (a["target"] - a["margin"]) * min(t / converge, 1.0)

        def phase(ahead, steady, t=t):
            if t <= cap:
                return ahead
            return ahead + (steady - ahead) * ((t - cap) / fade) if fade > 0 and t <= cap + fade else steady

        revenue = revenue * (1 + phase(a["growth"], a["stable_growth"]))
        earlier, nopat = nopat, revenue * phase(target, a["stable_margin"])
        pv = pv + (nopat - np.maximum(nopat - earlier, 0.0) / phase(a["roiic"], a["stable_roic"])) / (1 + a["wacc"]) ** t
    earned = revenue * (1 + a["stable_growth"]) * a["stable_margin"] * (1 - a["stable_growth"] / a["stable_roic"])
    return pv + earned / (a["wacc"] - a["stable_growth"]) / (1 + a["wacc"]) ** years


def survived(value: Column, failure: Column, recovery: Column) -> Column:
    """Value if the firm lasts, at its odds, and what is recovered if not."""
    return value * (1 - failure) + recovery * failure


def residual_income(book: Column, roe: Column, terminal_roe: Column, ke: Column, payout: float, growth: float, years: int) -> Column:
    """Book value with the present value of returns beyond the cost of equity, which fade to ``terminal_roe``."""

    def year(acc: Column, t: Column) -> Column:
        now = lerp(roe, terminal_roe, (t - 1) / (years - 1))
        return F.struct((acc["book"] * (1 + now * (1 - payout))).alias("book"), (acc["pv"] + acc["book"] * (now - ke) / F.pow(1 + ke, t)).alias("pv"))

    tail = lambda b: b * (1 + growth) * (terminal_roe - ke) / (ke - growth) / F.pow(1 + ke, F.lit(years))
    start = F.struct(book.alias("book"), F.lit(0.0).alias("pv"))
    return book + F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, year, lambda acc: acc["pv"] + tail(acc["book"]))


def adjusted_present_value(flows: Column, terminal: Column, shields: Column, unlevered: Column, shield_rate: Column, growth: Column, distress: Column) -> Column:
    """Unlevered flows and their terminal value, tax shields at their own rate, less the expected cost of distress."""
    later = gordon(terminal, unlevered, growth) / F.pow(1 + unlevered, F.size(flows))
    return discounted(flows, unlevered) + later + discounted(shields, shield_rate) - distress


def crossing(points: Column, level: Column, near: Column) -> Column:
    """``struct<status, x>``: where the line through ``array<struct<x, y>>`` meets ``level``, nearest to ``near`` of several.

    Without a crossing, ``x`` is null and the status tells on which side all points lie.
    """
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = F.filter(pairs, lambda p: (p["a"]["y"] - level) * (p["b"]["y"] - level) <= 0)
    at = lambda p: p["a"]["x"] + F.coalesce(F.try_divide((level - p["a"]["y"]) * (p["b"]["x"] - p["a"]["x"]), p["b"]["y"] - p["a"]["y"]), F.lit(0.0))
    found = F.transform(between, lambda p: F.struct(F.round(F.abs((p["a"]["x"] + p["b"]["x"]) / 2 - near), 9).alias("far"), p["a"]["x"].alias("from"), at(p).alias("x")))
    above = F.forall(points, lambda p: p["y"] < level)
    return let(found, lambda f: F.struct(
        F.when(F.size(f) > 0, "SOLVED").when(above, "CENSORED_HIGH").otherwise("CENSORED_LOW").alias("status"),
        F.when(F.size(f) > 0, F.array_min(f)["x"]).alias("x"),
    ))


def geometric(*parts: tuple[str, float]) -> Column:
    """100 times the weighted geometric mean of ``(score from 0 to 100, weight)``; zero if any score is."""
    out, zero = F.lit(100.0), F.lit(False)
    for score, weight in parts:
        out, zero = out * F.pow(F.col(score) / 100, F.lit(weight)), zero | (F.col(score) == 0)
    return F.when(zero, 0.0).otherwise(out)


def grid(*axes: tuple[float, ...], value: Callable[..., float]) -> Column:
    """``array<struct<p0, p1, ..., v>>`` of constants, a point for each combination."""
    points = [()]
    for axis in axes:
        points = [(*p, x) for p in points for x in axis]
    return F.array(*(F.struct(*(F.lit(float(x)).alias(f"p{i}") for i, x in enumerate(p)), F.lit(float(value(*p))).alias("v")) for p in points))


def curve_roots(points: Column, price: Column) -> Column:
    """``array<struct<x, low, high>>``: where a curve of ``struct<x, y>``, in order of x, has ``price``, straight between points.

    A point on the price is a root of its own; a null price has none.
    """
    at = lambda k: F.get(points, k)
    root = lambda x, low, high: F.struct(x.alias("x"), low.alias("low"), high.alias("high"))

    def between(k: Column) -> Column:
        left, right = at(k), at(k + 1)
        cut = left["x"] + F.coalesce(F.try_divide((price - left["y"]) * (right["x"] - left["x"]), F.when(right["y"] != left["y"], right["y"] - left["y"])), F.lit(0.0))
        last = (k == F.size(points) - 1) & (left["y"] == price)
        return F.when((left["y"] == price) | last, root(left["x"], left["x"], left["x"])).when((left["y"] - price) * (right["y"] - price) <= 0, root(cut, left["x"], right["x"]))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(points) - 1), between), lambda r: r.isNotNull())


def nearest_root(roots: Column, value: Column) -> Column:
    """The root nearest to ``value``, the first of several; null without any."""
    far = F.transform(roots, lambda r, k: F.struct(F.round(F.abs(r["x"] - value), 9).alias("far"), k.alias("k"), r.alias("root")))
    return F.array_min(far)["root"]


def frozen_revision(rows: DataFrame, points: str, supported: str, entry: str, target: str) -> DataFrame:
    """Adds ``status``, ``entry_root``, ``target_root`` and ``revision``: what two prices imply on one and the same curve.

    At the entry the root nearest to the supported value counts, at the target
    the one nearest to that. ``status`` is ``NO_ELIGIBLE_CURVE`` below two
    points, and tells which price lies outside the curve.
    """
    first = rows.withColumn("entry_root", nearest_root(curve_roots(F.col(points), F.col(entry)), F.col(supported)))
    second = first.withColumn("target_root", nearest_root(curve_roots(F.col(points), F.col(target)), F.col("entry_root.x")))
    short = F.coalesce(F.size(points) < 2, F.lit(True))
    status = F.when(short, "NO_ELIGIBLE_CURVE").when(F.col("entry_root").isNull(), "ENTRY_PRICE_OUTSIDE_CURVE").when(F.col("target_root").isNull(), "TARGET_PRICE_OUTSIDE_CURVE").otherwise("SOLVED")
    told = second.withColumn("status", status)
    solved = F.col("status") == "SOLVED"
    kept = {"entry_root": F.when(~short, F.col("entry_root")), "target_root": F.when(solved, F.col("target_root")), "revision": F.when(solved, F.col("target_root.x") - F.col("entry_root.x"))}
    return told.withColumns(kept)
