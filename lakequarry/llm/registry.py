"""Queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ("quality_rules", "packing", "kneser_ney", "license_scan", "media", "sharding", "simhash", "unigram_scan", "toxicity", "chat_format", "personal_data", "hard_negatives", "turn_repair")


def _merged(what: str) -> dict:
    return {name: x for m in MODULES for name, x in getattr(import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict:
    return _merged("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
