"""All engine queries and their SQL: importing the modules registers them."""

from __future__ import annotations

from . import more_queries as _more  # noqa: F401
from . import store_queries as _store  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
