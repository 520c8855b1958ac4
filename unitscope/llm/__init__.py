"""Operators of a training-data pipeline; nothing else in the library imports them."""

from importlib import import_module

_MODULES = ["html", "near_dup", "licenses", "lines", "mixing", "digests", "private", "toxicity", "quality", "packing", "hard_negatives", "lexical", "languages"]


def load_all() -> None:
    """Register the queries of every operator."""
    for module in _MODULES:
        import_module(f"unitscope.llm.{module}")
