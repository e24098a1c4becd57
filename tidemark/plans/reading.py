"""Pages and documents cut for a reader with a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import packed, semantic_chunks, text_pieces
from tidemark.sources import html
from tidemark.sources.tables import table

#: Small enough that the pages' tables are cut.
PAGE_TARGET, PAGE_LIMIT = 60, 100
TEXT_TARGET, TEXT_LIMIT = 1500, 2500


def page_nodes(spark, sf_dir: str) -> DataFrame:
    """Blocks of pages in order, tables with their full grids."""
    nodes = html.nodes(table(spark, sf_dir, "pages"))
    return nodes.select(F.col("page_id").alias("doc"), F.col("seq").cast("long").alias("order"), "section", "kind", "text", "header", "grid")


def page_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of pages within sections, tables cut by row, column and cell."""
    out = semantic_chunks(page_nodes(spark, sf_dir), PAGE_TARGET, PAGE_LIMIT)
    return out.select(F.col("doc").alias("page_id"), "chunk", "kind", "pieces", "first", "last", "tokens", F.sha2("text", 256).alias("text_sha256"))


def document_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of documents, whose lines are paragraphs of one section."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    nodes = lines.select(F.col("doc_id").alias("doc"), F.col("at").cast("long").alias("order"), F.lit("").alias("section"), F.lit("paragraph").alias("kind"), "text")
    out = packed(text_pieces(nodes, TEXT_LIMIT), TEXT_TARGET, TEXT_LIMIT)
    return out.select(F.col("doc").alias("doc_id"), "chunk", "kind", "pieces", "first", "last", "tokens", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"semantic_chunks": page_chunks, "document_chunks": document_chunks}

#: None: a piece begins where the one before was cut, character by character; both are tested against plain loops.
ORACLE_SQL: dict[str, str] = {}
