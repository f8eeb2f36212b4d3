"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["pii", "lm_score", "packing", "ann", "ngram_join", "substring_dedup", "quality_rules", "suffix_dedup", "piece_codec", "html_extract"]


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f".{name}", __package__), kind, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
