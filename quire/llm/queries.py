"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ["p01_glyphs", "p02_survivors", "p03_linkage", "p04_cutoff", "p05_neardup", "p06_scans", "p07_names", "p08_leaks", "p09_mixture", "p10_private"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f".{name}", __package__).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f".{name}", __package__), "SQL", {})
    return out
