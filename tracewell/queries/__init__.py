"""The registered queries of the engine's own operators, and their SQL."""

from . import analytics, ingest, joins, provenance, search, tools  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
