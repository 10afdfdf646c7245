"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("nested", "drifting", "extraction", "auditing", "evaluation", "layout", "checking", "learning", "assembling", "exchanging")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"folioflow.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
