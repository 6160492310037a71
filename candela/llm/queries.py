"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity, warc

_MODULES = (token_counts, toxicity, exact_dedup, warc, bpe, quality, near_dedup, suffix_dedup, mixing, html_text)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
