"""Copies and changes among documents that play the same role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pairs import COPY, classes_and_pairs, kept_in_order, shingles, with_copies
from tidemark.sources.tables import table

ROLES = 13


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % ROLES).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def near_copies(spark, sf_dir: str) -> DataFrame:
    """Documents that an earlier kept one makes a copy or a change: the earliest such, its similarity, and the kind."""
    copies, pairs = classes_and_pairs(_chunks(spark, sf_dir), "doc_id", "role", "text")
    copy = (F.col("similarity") >= COPY) & F.col("same_numbers")
    # a row with the text of an earlier one is never kept: that one is, or what makes it a copy
    dropped = kept_in_order(pairs.filter(copy & (F.col("newer") > F.col("older")))).filter("not kept").select(F.col("key").alias("older"))
    between = with_copies(pairs.join(dropped, "older", "left_anti"), copies, "newer").filter("newer > older").select(*pairs.columns)
    equal = copies.select(F.col("key").alias("newer"), F.col("first").alias("older"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same_numbers")).join(dropped, "older", "left_anti")
    against = between.unionByName(equal.select(*pairs.columns))
    kind = F.when(copy & (F.col("similarity") == 1), "EXACT").when(copy, "NEAR").when(~F.col("same_numbers"), "CHANGED")
    named = against.withColumn("kind", kind).filter("kind is not null")
    first = named.groupBy("newer").agg(F.min_by(F.struct("older", "similarity", "kind"), F.struct(F.col("kind") == "CHANGED", "older")).alias("x"), F.count_if(F.col("kind") == "CHANGED").alias("changes"))
    return first.select(F.col("newer").alias("doc_id"), F.col("x.older").alias("canonical"), F.round("x.similarity", 6).alias("similarity"), F.col("x.kind").alias("kind"), "changes")


def shingle_counts(spark, sf_dir: str) -> DataFrame:
    """Distinct runs of three tokens of each document."""
    return _chunks(spark, sf_dir).select("doc_id", F.size(shingles(F.lower(F.col("text")))).cast("long").alias("shingles"))


QUERIES = {"near_dup_changes": near_copies, "comparison_shingles": shingle_counts}

#: None: the sequence ratio has no function in SQL; it is tested against a plain loop.
ORACLE_SQL: dict[str, str] = {}
