"""The registered queries: each is a Spark function with, where SQL can say it, the same in SQL."""

from __future__ import annotations

from workload import deidentify, detection, lookups, sources, text

QUERIES = {}
ORACLES = {}
for _module in (sources, detection, lookups, text, deidentify):
    for _key, (_run, _sql) in _module.ENTRIES.items():
        QUERIES[_key] = _run
        if _sql is not None:
            ORACLES[_key] = _sql
