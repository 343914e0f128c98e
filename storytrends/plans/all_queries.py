"""Imports every query module, which fills the registry."""

from . import (  # noqa: F401
    queries_explore,
    queries_io,
    queries_popularity,
    queries_text,
    queries_topics,
    queries_vectors,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
