"""Registered queries of the text operators: name -> callable, and the DuckDB statement where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: query -> module (each has a function of the query's name, and ``SQL`` if DuckDB can express it)
MODULES = {
    "op1_ngram_lm": "ngram_lm",
    "op2_pii": "pii",
    "op3_decontamination": "decontaminate",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_quality": "quality",
    "op6_mixing": "mixing",
    "op7_training_order": "materialise",
    "op8_simhash": "simhash",
    "op9_chat": "chat",
    "op10_order_minhash": "minhash_order",
    "op11_hard_negatives": "hard_negatives",
    "op12_prefix_trie": "prefix_trie",
    "op13_exact_dedup": "patricia",
}


def queries() -> dict:
    return {name: getattr(import_module(f"veloscope.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"veloscope.llm.{m}"), "SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
