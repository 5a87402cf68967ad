"""Registered queries over the driver tables, each with equivalent SQL where SQL can say it."""

from catalog import (  # noqa: F401
    change_queries, clean_queries, evaluation_queries, extract_queries, filter_queries,
    log_queries, quality_queries, retrieval_queries, search_queries, source_queries, stream_queries)
from catalog.registry import QUERIES, SQL  # noqa: F401
