"""The queries of the engine's own operators, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from ..operators import nested
from ..sources import table
from . import ranking, retrieval, sessions

_PARTS = [retrieval, ranking, sessions]


def queries() -> dict:
    out = {
        "p4_found": lambda s, d: nested.list_elements(table(s, d, "raw_records")),
        "p4_tables": lambda s, d: nested.typed_tables(table(s, d, "raw_records")),
    }
    for part in _PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for part in _PARTS:
        out |= part.ORACLE
    return out
