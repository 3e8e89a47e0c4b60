"""Queries over the test tables, one or more per operator, each with its SQL equivalent."""

from stratiform.registry import core, enrichment, history, ingested, jobs, serving, streams

_MODULES = (enrichment, core, serving, jobs, streams, history, ingested)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
