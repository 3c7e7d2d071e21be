"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and, where SQL can express them, ORACLES.
PARTS: tuple[str, ...] = ("token_counts", "token_files", "simhash", "secrets", "mixing", "quality", "language", "decontaminate", "repeats", "toxicity", "passages", "search", "phrases")


def load_all() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for part in PARTS:
        module = importlib.import_module(f"docweave.llm.{part}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    pipeline = importlib.import_module("corpus_pipeline")
    queries["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
