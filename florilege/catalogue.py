"""Every registered query of the engine itself and, where SQL can express it, the DuckDB statement with the same result."""

from .plans import judgements  # noqa: F401
from .plans.quotations import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
