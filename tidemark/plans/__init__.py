"""Every registered query of the engine's own operators."""

from __future__ import annotations

from tidemark.plans import stores, timeseries

QUERIES = timeseries.QUERIES | stores.QUERIES
SQL = timeseries.SQL | stores.SQL
