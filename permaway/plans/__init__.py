"""Driver queries; importing the modules fills the registry."""

from permaway.plans import aggregating, feeds, joining, ordering, stateful  # noqa: F401
from permaway.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
