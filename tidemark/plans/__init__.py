"""Registered queries: each module has Q (functions by name) and SQL (their DuckDB text)."""

from . import assets, loads, market, profiles, texts

PLANS = (market, texts, loads, profiles, assets)
