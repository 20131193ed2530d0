"""All registered queries."""

from postingworks.catalog import (  # noqa: F401
    board_queries,
    classify_queries,
    filter_queries,
    join_queries,
    lifecycle_queries,
    payload_queries,
    text_queries,
    view_queries,
)
from postingworks.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
