"""The registered queries and their SQL, gathered from the modules of ``siteglass.plans``."""

from __future__ import annotations

from .plans import flagship
from .plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
