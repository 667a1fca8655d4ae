"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from docloom.llm import bitplane, collocations, decision_list, exact_dedup, importance, latent, line_crf, line_spread, mixing, sharding, simhash, toxicity, warc

_MODULES = [latent, decision_list, toxicity, bitplane, mixing, line_spread, line_crf, warc, sharding, simhash, importance, exact_dedup, collocations]


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
