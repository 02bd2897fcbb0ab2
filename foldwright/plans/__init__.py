"""The registered queries: each a Spark plan over the given tables and, where possible, the same in SQL."""

from foldwright.plans import baseline, blends, boosted, exact, ingest, learned, metric, neighbour  # noqa: F401
from foldwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
