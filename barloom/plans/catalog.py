"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import books, decisions, forward, ideas, ingest, live, prices, runs, statements

MODULES = (ingest, prices, decisions, ideas, runs, books, forward, statements, live)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: text for m in MODULES for name, text in m.ORACLES.items()}

# Newest regime-gated signal of every instrument.
flagship = QUERIES["SIG9_latest_signals"]
