"""Queries over the driver tables, each a Spark function with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ("group_queries", "score_queries", "network_queries", "resource_queries", "spatial_queries", "predict_queries", "job_queries")


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(import_module(f"catalog.{m}").QUERIES)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(import_module(f"catalog.{m}").SQL)
    return out
