"""All queries of the package."""

from . import job_queries, layout_queries, source_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
