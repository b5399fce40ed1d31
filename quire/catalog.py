"""All queries of the reading-side operators, each with its SQL twin for DuckDB."""

from __future__ import annotations

from quire import queries_agents, queries_documents, queries_files, queries_library, queries_state, queries_streams

_MODULES = (queries_documents, queries_state, queries_library, queries_agents, queries_streams, queries_files)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
