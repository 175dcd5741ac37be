"""Registered queries and their SQL."""

from noisegrid.plans import assembly, checks, files, formulas, upkeep  # noqa: F401  they register their queries
from noisegrid.plans.queries import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
