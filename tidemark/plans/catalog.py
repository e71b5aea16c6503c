"""All registered queries."""

from tidemark.plans import q_clean, q_inject, q_report, q_scale, q_score, q_sources, q_split, q_windows  # noqa: F401
from tidemark.plans.q_score import flagship
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
