"""All registered queries; importing the query modules fills the tables."""

from __future__ import annotations

from plumbline.plans import calibration_queries, group_queries, row_queries, text_queries, token_queries  # noqa: F401
from plumbline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
