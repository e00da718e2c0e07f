"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quillbar.llm import byte_bpe, html, jaccard, language, licenses, lines, minhash, negatives, nearest, packing, resampling, topk, training_order

MODULES = [jaccard, lines, training_order, language, packing, html, nearest, topk, licenses, byte_bpe, negatives, minhash, resampling]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
