"""The registered plans."""

from hitloom.plans import hits, physics, stores, tracks, variants  # noqa: F401
from hitloom.plans.registry import ORACLES, QUERIES  # noqa: F401
