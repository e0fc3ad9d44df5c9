"""Queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("token_files", "token_counts", "divergence", "byte_net", "main_text", "partition_join", "containment", "sentence_pieces", "url_lists", "quotations",
           "merkle", "personal_data", "spellings")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(importlib.import_module(f"abacist.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
