"""Operators for preparing training data; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "token_files", "packing", "chat", "language", "topk", "fingerprints", "jaccard", "html_text", "token_counts", "resampling", "structure_repair", "toxicity")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "SQL", {}).items()}
