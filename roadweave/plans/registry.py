"""All queries of the network engine and their DuckDB twins."""

from __future__ import annotations

from roadweave.plans import catalog, codecs, guidance, matching, outputs, routes, shapes
from roadweave.streaming import live

MODULES = (catalog, shapes, codecs, routes, matching, outputs, guidance, live)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
