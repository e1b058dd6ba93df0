"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tidelark.llm import op01_line_dedup, op02_pieces, op03_language, op04_packed, op05_pii, op06_token_counts, op07_mixing, op08_minmax_dedup, op09_topk, op10_spotsigs, op11_runs, op12_toxicity, op13_vector_codes

_MODULES = [op01_line_dedup, op02_pieces, op03_language, op04_packed, op05_pii, op06_token_counts, op07_mixing, op08_minmax_dedup, op09_topk, op10_spotsigs, op11_runs, op12_toxicity, op13_vector_codes]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
