"""All flow and alert queries: importing a module of queries registers them."""

from . import baselines, captures, evaluation, forecasting, graphs, hosts, labelling, live_state, logs, metric_queries, queries, reports, selection  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
