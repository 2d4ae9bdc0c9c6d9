"""All registered queries over the given tables."""

from __future__ import annotations

import importlib

from furlong.catalog.registry import ORACLES, QUERIES

MODULES = ["history", "reports", "scores", "monitors", "entities", "captures", "shapes", "flows"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"furlong.catalog.{module}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
