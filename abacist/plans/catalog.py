"""All registered queries and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("usage", "feedback", "metrics", "safety", "registry", "wallet", "texts", "live")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"abacist.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def _in_utc(query):
    """The query with the session's zone pinned: days and ISO texts must not depend on where it runs."""
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _in_utc(query) for name, query in _collect("QUERIES").items()}


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
