"""All registered queries."""

from pixelloom.workload import curation, images, labels, points, regions, sessions, training  # noqa: F401
from pixelloom.workload.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
