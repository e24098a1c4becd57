"""Sentences of conversations as pieces of evidence, their relations, and the ledger these close."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relations import evidence_relations
from tidemark.sources.stores import apply_relations, merge_ledger
from tidemark.sources.tables import table

LEDGER_OPENED, RELATIONS_AT = "2024-01-01", "2024-02-01"


def sentence_cards(spark, sf_dir: str) -> DataFrame:
    """A card for each sentence of each turn; one longer than the sentence of the same role before it speaks for, a shorter one against."""
    sentences = F.posexplode(F.split("text", r"[.!?\n]+"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", sentences.alias("at", "text")).filter(F.btrim("text") != "")
    before = F.lag(F.length("text")).over(Window.partitionBy("conv_id", "role").orderBy("turn", "at"))
    told = rows.withColumn("before", before)
    direction = F.when(F.length("text") > F.col("before"), "UP").when(F.length("text") < F.col("before"), "DOWN").otherwise("NEUTRAL")
    return told.select("conv_id", F.format_string("%d-%06d-%06d", "conv_id", F.col("turn").cast("int"), "at").alias("card"), "role", direction.alias("direction"), "text")


def relations(spark, sf_dir: str) -> DataFrame:
    """The first earlier sentence of the same role in its conversation that each sentence repeats, updates, contradicts, weakens or supports."""
    return evidence_relations(sentence_cards(spark, sf_dir), "conv_id", "card", "role", "direction", "text")


def related_ledger(spark, sf_dir: str) -> DataFrame:
    """A ledger of all sentences, closed where a later one repeats, updates or contradicts one."""
    cards = sentence_cards(spark, sf_dir).select(F.col("conv_id").cast("string").alias("ticker"), F.col("card").alias("evidence_id"), F.col("text").alias("fact"))
    empty = cards.limit(0).select("ticker", "evidence_id", *(F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_to", "last_confirmed_at")), "fact")
    ledger = merge_ledger(empty, cards, LEDGER_OPENED)
    tied = relations(spark, sf_dir).withColumnRenamed("conv_id", "ticker").withColumn("ticker", F.col("ticker").cast("string"))
    closed = apply_relations(ledger, tied, RELATIONS_AT)
    return closed.select("ticker", "evidence_id", F.col("valid_to").isNotNull().alias("closed"), F.coalesce("superseded_by", "retracted_by").alias("closed_by"), F.col("retracted_by").isNotNull().alias("retracted"))


QUERIES = {"evidence_relations": relations, "ledger_relations": related_ledger}

#: None: the ratio of matching characters has no function in SQL; both are tested against a plain loop.
ORACLE_SQL: dict[str, str] = {}
