"""Registered queries over the driver's tables, with their DuckDB twins."""

from heddle.plans import code, corpus, evaluation, graphs, planning, solutions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (evaluation, corpus, graphs, solutions, planning, code):
    QUERIES |= _part.Q
    ORACLE_SQL |= _part.SQL
