"""All registered queries and SQL twins."""

from __future__ import annotations

from catalog import describe_queries, mixed_queries, model_queries, persist_queries, shape_queries
from catalog.base import Query

MODULES = [shape_queries, persist_queries, describe_queries, model_queries, mixed_queries]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
