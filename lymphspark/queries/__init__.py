"""The registered queries by family; each module has QUERIES and, where SQL can express the operator, ORACLES."""

from __future__ import annotations

import importlib

MODULES = ("general", "text", "tables", "measures", "network", "plans", "files")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"{__name__}.{name}"), what).items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = value
    return out


def all_queries() -> dict:
    return _gather("QUERIES")


def all_oracles() -> dict:
    return _gather("ORACLES")


def flagship(spark, folder: str):
    return importlib.import_module(f"{__name__}.text").flagship(spark, folder)
