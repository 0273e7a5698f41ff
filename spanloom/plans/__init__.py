"""Queries that apply the operators to the driver's tables, each with the same query in DuckDB SQL where that can be."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["token_queries", "span_queries", "rewrite_queries", "graph_queries", "model_queries", "task_queries", "feature_queries", "report_queries", "chain_queries", "segment_queries", "tagger_queries"]


def _modules():
    return [import_module(f"spanloom.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
