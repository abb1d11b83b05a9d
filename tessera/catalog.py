"""Registry of the engine's own queries and of their SQL."""

from __future__ import annotations

import importlib

_MODULES: tuple[str, ...] = ("factor_plans", "evaluation_plans", "repository_plans", "pit_plans", "news_plans", "strategy_plans", "research_plans", "streaming_plans")


def _loaded():
    return [importlib.import_module(f"tessera.plans.{name}") for name in _MODULES]


def queries() -> dict:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return {k: v for module in _loaded() for k, v in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: v for module in _loaded() for k, v in module.ORACLE.items()}
