"""All queries of the engine's own operators, and their SQL."""

from . import corrections, people, records, rendering, stored, transcripts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
