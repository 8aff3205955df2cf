"""All queries of the library by name, and the SQL each is checked against."""

from __future__ import annotations

from . import index, models, places, relational, spatial, streams, studies, text  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "affordability_index_district"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
