"""All registered queries and oracles, gathered from the area modules."""

from __future__ import annotations

from docloom.workload import (
    answer_queries, chunk_queries, retrieval_queries, table_queries, text_queries,
)

QUERIES: dict = {}
ORACLES: dict = {}
for module in (text_queries, chunk_queries, retrieval_queries, table_queries, answer_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
