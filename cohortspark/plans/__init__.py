"""Queries: library operators on the test tables, each with its SQL twin where one exists."""

from cohortspark.plans.registry import REGISTRY, bind
from cohortspark.plans import (q_sources, q_counts, q_association, q_contrast, q_curves, q_evaluation, q_models, q_resample, q_spatial)  # noqa: F401

__all__ = ["REGISTRY", "bind"]
