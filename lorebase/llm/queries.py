"""Queries of the language-model problems; one module each in this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("p2", "p3", "p5", "p6", "p7", "p8", "p9", "p10")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    try:
        _module = importlib.import_module(f"lorebase.llm.{_name}")
    except ModuleNotFoundError as _error:
        if _error.name != f"lorebase.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
