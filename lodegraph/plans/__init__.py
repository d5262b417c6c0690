"""All registered queries and their SQL."""

from . import analytics, graph, intents, pipelines, search, state, streams
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "graph", "intents", "pipelines", "search", "state", "streams"]
