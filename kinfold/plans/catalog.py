"""Imports every query module so the registry is complete."""

from . import q_cascades, q_eval, q_features, q_fitted, q_groups, q_models, q_profile, q_sources, q_votes  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
