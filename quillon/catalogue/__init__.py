"""Queries over the driver's tables: each operator on a stand-in for its relation, with SQL."""

from .queries import QUERIES
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
