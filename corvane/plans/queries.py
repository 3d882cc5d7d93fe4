"""All registered queries of the library."""

from corvane.plans import evaluations, extraction, memories, packings, retrieval, snapshots  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES  # noqa: F401
