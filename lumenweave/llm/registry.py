"""Queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

from lumenweave.llm import ann, exact_dedup, html_tree, license_scan, lm_score, manifest, media, minhash_dedup, mixing, packing, resharding, toxicity, whitening

MODULES = (packing, mixing, media, toxicity, lm_score, minhash_dedup, exact_dedup, resharding, html_tree, license_scan, ann, manifest, whitening)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
