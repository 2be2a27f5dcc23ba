"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Each module has QUERIES and ORACLES; a module that is missing is an error.
MODULES = ["q_tables", "q_pages", "q_quality", "q_vectors", "q_repeats", "q_tokens", "q_filters", "q_turns"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"canlake.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
