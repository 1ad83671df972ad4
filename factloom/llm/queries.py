"""Queries of the problems on text and code, by number, and their SQL where SQL can express them."""

from __future__ import annotations

from factloom.llm import abuse, documented, encode, handwritten, packing, parsing
from factloom.sources.tables import load

QUERIES = {
    "p1_found": lambda s, d: documented.documented(load(s, d, "symbols"), load(s, d, "source_files"), load(s, d, "source_texts")),
    "p1_pairs": lambda s, d: documented.pairs(load(s, d, "symbols"), load(s, d, "source_files"), load(s, d, "source_texts")),
    "p2_found": lambda s, d: handwritten.not_handwritten(load(s, d, "source_files"), load(s, d, "source_texts"), load(s, d, "upstream_files"), load(s, d, "projects")),
    "p2_origins": lambda s, d: handwritten.origins(load(s, d, "source_files"), load(s, d, "source_texts"), load(s, d, "upstream_files"), load(s, d, "projects")),
    "p4_found": lambda s, d: parsing.broken(load(s, d, "source_files"), load(s, d, "source_texts")),
    "p4_rates": lambda s, d: parsing.rates(load(s, d, "source_files"), load(s, d, "source_texts")),
    "p6_ids": lambda s, d: encode.encode_documents(load(s, d, "documents")),
    "p7_containers": lambda s, d: packing.pack_documents(load(s, d, "documents"), load(s, d, "context_budgets")),
    "p7_fill": lambda s, d: packing.fill_report(packing.pack_documents(load(s, d, "documents"), load(s, d, "context_budgets")), load(s, d, "context_budgets")),
    "p8_found": lambda s, d: abuse.offensive(load(s, d, "documents"), load(s, d, "review_labels")),
    "p8_scores": lambda s, d: abuse.scores(load(s, d, "documents"), load(s, d, "review_labels")),
    "p8_rates": lambda s, d: abuse.rates(load(s, d, "documents"), load(s, d, "review_labels")),
}

ORACLE: dict[str, str] = {}
