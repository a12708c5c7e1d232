"""The registered queries (spark, sf_dir) -> DataFrame of the library's operators, and their SQL for DuckDB."""

from .plans import links, media, pages, sessions, streams, threads  # noqa: F401
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
