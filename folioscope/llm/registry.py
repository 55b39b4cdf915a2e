"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

#: One module for each operator, in the operators' order.
MODULES = ("sharding", "html_extraction", "decontamination", "simhash", "pii", "embedding_dedup", "chat", "toxicity", "bpe", "suffix_tree_lm", "spelling_variants", "merkle_manifest", "token_counts")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"folioscope.llm.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
