"""Runnable queries over the given tables, one module per area."""

from importlib import import_module, util

MODULES = ("q_rent", "q_match", "q_quality", "q_versions", "q_invest", "q_geo", "q_hedonic", "q_sources", "q_text", "q_ranking", "q_compare", "q_status", "q_upkeep")


def load_all() -> None:
    for name in MODULES:
        full = f"lares.plans.{name}"
        if util.find_spec(full) is not None:
            import_module(full)
