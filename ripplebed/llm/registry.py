"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name, module of this package.
QUERIES = {
    "op1_suffix_tree": "suffix_tree",
    "op2_token_store": "token_store",
    "op3_line_dedup": "line_dedup",
    "op4_minhash": "minhash",
    "op5_exact_dedup": "exact_dedup",
    "op6_language_id": "language_id",
    "op7_bpe_automaton": "bpe_automaton",
    "op8_quality_rules": "quality_rules",
    "op9_sharding": "sharding",
    "op10_packing": "packing",
    "op11_conversation_repair": "conversation_repair",
    "op12_compaction": "compaction",
    "op13_rank_queue": "rank_queue",
}


def queries() -> dict:
    return {name: getattr(import_module(f"ripplebed.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"ripplebed.llm.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
