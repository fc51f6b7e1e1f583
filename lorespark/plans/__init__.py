"""Registered queries: what each computes from the driver's tables, and the same in SQL."""

from __future__ import annotations

from lorespark.plans import corrections, progress, quiz, structure, study, texts, watermarks

MODULES = (progress, quiz, structure, texts, study, corrections, watermarks)


def all_queries() -> dict[str, tuple]:
    """name -> (function of (spark, sf_dir), SQL or None)"""
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
