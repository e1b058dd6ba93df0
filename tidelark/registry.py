"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from tidelark.operators import access, aggregates, catalog, components, diffs, graphs, hierarchy, imports, keywords, listing, records, search, snapshots, symbols, usage, vectors
from tidelark.sources import queries as stores
from tidelark.streaming import events, keyed

_MODULES = [aggregates, listing, access, catalog, usage, search, graphs, hierarchy, imports, symbols, stores, events, vectors, keywords, components, diffs, snapshots, records, keyed]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
