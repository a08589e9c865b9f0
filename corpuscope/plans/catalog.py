"""All named queries. Importing a module registers its queries."""

from corpuscope.plans import (  # noqa: F401
    queries_aggregates, queries_graph, queries_joins, queries_models, queries_rules,
    queries_report, queries_scalars, queries_sources, queries_streaming,
)
from corpuscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
