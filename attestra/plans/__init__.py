"""Queries over the project's tables; importing the package registers them."""

from attestra.plans import (  # noqa: F401
    chunk_queries, claim_queries, join_queries, metric_queries, ranking_queries, selection_queries, text_queries,
)
