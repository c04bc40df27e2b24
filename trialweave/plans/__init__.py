"""Every operator as a named query over the given tables."""

from trialweave.plans import (  # noqa: F401
    aggregates,
    decisions,
    decoding,
    files,
    filters,
    joins,
    scalars,
    signals,
    statistics,
    windows,
)
from trialweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
