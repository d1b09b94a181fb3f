"""All registered queries."""

from cueflow.plans import (  # noqa: F401
    check_queries,
    correction_queries,
    knowledge_queries,
    source_queries,
    tenant_queries,
)
from cueflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
