"""Queries over the test tables; importing the package registers them."""

from . import (  # noqa: F401
    call_queries,
    count_queries,
    expression_queries,
    leak_queries,
    pair_queries,
    relational_queries,
    source_queries,
    stack_queries,
    state_queries,
    stream_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
