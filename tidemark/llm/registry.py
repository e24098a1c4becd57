"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.licenses import op7_licenses
from tidemark.llm.line_dedup import op8_line_dedup
from tidemark.llm.mixing import OP9_SQL, op9_mixing
from tidemark.llm.neighbours import op5_neighbours
from tidemark.llm.packing import op4_packing
from tidemark.llm.phrases import OP11_SQL, op11_phrases
from tidemark.llm.pii import op1_pii
from tidemark.llm.quality import op3_quality
from tidemark.llm.simhash import op2_simhash
from tidemark.llm.tokens import op10_token_counts
from tidemark.llm.toxicity import op12_toxicity
from tidemark.llm.urls import OP6_SQL, op6_urls
from tidemark.llm.variants import op13_variants

QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_neighbours": op5_neighbours,
    "op6_urls": op6_urls,
    "op7_licenses": op7_licenses,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_phrases": op11_phrases,
    "op12_toxicity": op12_toxicity,
    "op13_variants": op13_variants,
}

ORACLE_SQL: dict[str, str] = {"op6_urls": OP6_SQL, "op9_mixing": OP9_SQL, "op11_phrases": OP11_SQL}
