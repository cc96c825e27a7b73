"""All registered queries with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

from loamwork.plans.registry import QUERIES, SQL

MODULES = ("wetness_queries", "series_queries", "stats_queries", "join_queries", "domain_queries", "model_queries", "source_queries", "field_queries")
for _m in MODULES:
    import_module(f"loamwork.plans.{_m}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def FLAGSHIP(spark, sf_dir):
    """Per-field wetness classes: daily aggregation, window, adjacent-cycle count, classes."""
    return QUERIES["wet_classes"](spark, sf_dir)
