"""All named queries of the core, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["dedup_plans", "relational_plans", "text_plans", "stats_plans", "stream_plans", "more_plans", "filename_plans", "score_plans", "check_plans"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f".{name}", __package__).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f".{name}", __package__).SQL
    return out
