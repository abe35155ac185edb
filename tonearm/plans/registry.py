"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from tonearm.plans import analytics, audio, browse, form, library, pairing, playing, signals
from tonearm.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (library, browse, analytics, signals, audio, form, pairing, playing):
    QUERIES |= module.PLANS.queries
    ORACLE_SQL |= module.PLANS.oracle_sql
