"""All queries of the library and their SQL."""

from .plans import entities, events, graphs, histories, holdings, reviews, stores, streams, texts, transitions, vectors  # noqa: F401  (they register themselves)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
