"""Registered queries: each operator on the given tables, with the same question as SQL where it can be put so."""

from . import cohort, genetics, models, reconciliation, scores  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
