"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import citeweave.llm as here

QUERIES: dict = {}
ORACLE: dict = {}
for _m in sorted(m.name for m in pkgutil.iter_modules(here.__path__) if m.name.startswith("q") and m.name[1:].isdigit()):
    _q = importlib.import_module(f"citeweave.llm.{_m}")
    QUERIES |= _q.QUERIES
    ORACLE |= _q.ORACLE
