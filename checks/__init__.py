"""Queries over the driver's tables with their DuckDB counterparts."""

from checks.registry import ORACLES, QUERIES
from checks import cohort, filters, intervals, pileups, pipelines, sequences, signals, stats  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
