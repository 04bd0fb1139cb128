"""Importing the query modules fills the registry."""

from cohortlens.plans import (  # noqa: F401
    drift_queries,
    evaluate_queries,
    feature_queries,
    model_queries,
    panel_queries,
    profit_queries,
    sampling_queries,
    source_queries,
)
from cohortlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
