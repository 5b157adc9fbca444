"""Registered queries and their DuckDB counterparts."""

from . import graphs, kernels, relational, shapes, statistics, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
