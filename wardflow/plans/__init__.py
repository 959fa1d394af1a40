"""Batch jobs and the catalogue of registered queries."""

from __future__ import annotations


def _load() -> None:
    import importlib

    for group in ("operations", "history", "intervals", "schedule", "metrics", "quality", "models", "streams"):
        importlib.import_module(f"wardflow.plans.registered_{group}")


def queries() -> dict:
    from wardflow.plans import catalog

    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    from wardflow.plans import catalog

    _load()
    return dict(catalog.ORACLES)
