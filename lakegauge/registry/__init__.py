"""Every registered query, by name, with the SQL that checks it."""

from lakegauge.registry import answers, metrics, profiling

_MODULES = (metrics, profiling, answers)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
