"""Operators of a training-data pipeline; nothing else in the package imports them."""

import importlib

from quire.llm.registry import ORACLES, QUERIES

MODULES = [
    "byte_cnn", "fourier_quality", "weak_rules", "mixing", "containment", "jaccard_join", "main_text",
    "ngram_trie", "token_store", "tool_calls", "toxicity", "vector_codes", "spelling",
]

for _name in MODULES:
    importlib.import_module(f"quire.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
