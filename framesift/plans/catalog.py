"""All registered queries."""

from __future__ import annotations

from framesift.plans import datasets, imaging, ordered, streams, tabular  # noqa: F401
from framesift.plans.ordered import flagship
from framesift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
