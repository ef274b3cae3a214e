"""All runnable queries, grouped by area. Importing the package fills the registry."""

from tracelore.catalog.base import REGISTRY, Query, Tables, query
from tracelore.catalog import accounts, events, graph, memory, recall, skills, streams  # noqa: F401, E402

__all__ = ["REGISTRY", "Query", "Tables", "query"]
