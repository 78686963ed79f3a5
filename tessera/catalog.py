"""Registered queries of the library and their SQL."""

from __future__ import annotations

from tessera.plans import host, host_sql
from tessera.plans import queries as _queries
from tessera.plans.oracle import ORACLE as _MAP

ORACLE = _MAP | host_sql.SQL
QUERIES = {name: getattr(_queries, name) for name in [*_MAP, "label_layout", "gesture_session"]} | {name: getattr(host, name) for name in host_sql.SQL}
