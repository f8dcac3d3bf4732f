"""Queries: the operators applied to tables, each with equivalent SQL."""

from . import answering, more, relational, stages, state, text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
