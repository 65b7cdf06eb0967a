"""Queries opN_<name> over the tables of a folder, and their DuckDB twins."""

from __future__ import annotations

from . import conversation_trie, exact_dedup, hard_negatives, line_dedup, mixing, ngram_jaccard, packing, sharding, substring_dedup, suffix_dedup, token_output, topk, toxicity

MODULES = (exact_dedup, substring_dedup, suffix_dedup, token_output, line_dedup, ngram_jaccard, sharding, topk, mixing, packing, toxicity, suffix_dedup, conversation_trie, hard_negatives)


def queries() -> dict:
    found = {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
