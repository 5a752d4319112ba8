"""Names of all registered queries, and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["operators.lookup", "operators.joins", "operators.aggregates", "operators.windows", "operators.paths", "operators.vectors", "operators.hybrid", "operators.upsert", "functions.text", "operators.knowledge", "operators.models", "operators.context", "operators.dimensions", "operators.records", "operators.embedding", "functions.markdown", "functions.parsers", "functions.languages", "streaming.events", "sources.portable"]


def _modules():
    return [importlib.import_module(f"graphloom.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
