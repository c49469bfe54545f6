"""All registered queries."""

from lamina.queries import composition, explain, layers, models, rows, sources, splits, stats, transforms  # noqa: F401
from lamina.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
