"""Registered queries; importing this package fills the registry."""

from ruleloom.plans.registry import QUERIES
from ruleloom.plans import (  # noqa: F401
    q_sources,
    q_extract,
    q_predicates,
    q_composites,
    q_findings,
    q_metrics,
    q_joins,
    q_manifests,
    q_catalog,
    q_scan,
    q_streaming,
)

__all__ = ["QUERIES"]
