"""Greedy choices of text pieces within a budget of tokens, one document at a time."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship_package

#: Tokens that a role gets before the rest is filled.
MINIMUMS = {"BUSINESS": 800, "COMPETITION": 600, "CUSTOMERS": 400, "RISK": 500}


def choose(pieces: pd.DataFrame, budget: int, weights: Mapping[str, float], minimums: Mapping[str, int]) -> pd.Series:
    """Which of a document's pieces, in order, are taken: first each role's best up to its minimum, then the best of all that fit.

    A piece is worth its role's weight times its relevance, at least 0.01, over the root of its tokens.
    """
    relevance = pieces["relevance"].fillna(0.01).clip(lower=0.01)
    worth = pieces["role"].map(lambda r: weights.get(r, 0.01)) * relevance / pieces["tokens"].clip(lower=1) ** 0.5
    order = worth.sort_values(ascending=False, kind="stable").index
    taken, used = set(), 0
    for role in dict.fromkeys(pieces["role"]):
        own = 0
        for at in order:
            tokens = pieces.at[at, "tokens"]
            if pieces.at[at, "role"] == role and own < minimums.get(role, 0) and used + tokens <= budget:
                taken.add(at)
                own, used = own + tokens, used + tokens
    for at in order:
        if at not in taken and used + pieces.at[at, "tokens"] <= budget:
            taken.add(at)
            used += pieces.at[at, "tokens"]
    return pieces.index.to_series().isin(taken)


def within_budget(pieces: DataFrame, budget: int, weights: Mapping[str, float], minimums: Mapping[str, int] = MINIMUMS) -> DataFrame:
    """``(document, position, role, tokens, relevance, taken)`` of ``pieces`` with these columns but the last.

    A document's pieces are together in one task; texts do not travel.
    """
    ship_package(pieces.sparkSession)
    named = pieces.select("document", "position", "role", "tokens", F.col("relevance").cast("double").alias("relevance"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("position").reset_index(drop=True)
        return ordered.assign(taken=choose(ordered, budget, weights, minimums).to_numpy())

    schema = ", ".join(f"{n} {t}" for n, t in named.dtypes) + ", taken boolean"
    return named.groupBy("document").applyInPandas(run, schema)


def batches(tokens: Column, most: int) -> Column:
    """The number, from 0, of each piece's batch: a batch ends before the piece that would take it over ``most``."""

    def step(acc: Column, t: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + t > most)
        at = acc["at"] + full.cast("int")
        return F.struct(at.alias("at"), (F.when(full, 0).otherwise(acc["used"]) + t).alias("used"), F.concat(acc["out"], F.array(at)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(tokens, lambda t: t.cast("long")), start, step, lambda acc: acc["out"])
