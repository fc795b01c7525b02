"""All queries of the library's own operators."""

from . import more, report_queries, source_queries  # noqa: F401  (register their queries)
from .registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
