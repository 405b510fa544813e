"""Registered queries."""

from tarnfold.plans import agents, dashboard, logs, rows, texts  # noqa: F401
from tarnfold.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
