"""Registered queries over the given tables, each with its reference SQL where SQL can express it."""

from __future__ import annotations

from partflow.queries import cost, evidence, features, ingestion, leaks, logs, metrics, model, splits
from partflow.queries.registry import Query

MODULES = (ingestion, splits, features, metrics, cost, evidence, leaks, model, logs)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.name in out:
                raise ValueError(f"query {query.name} is registered twice")
            out[query.name] = query
    return out
