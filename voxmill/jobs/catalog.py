"""All queries of the library and their oracles: importing the modules registers them."""

from __future__ import annotations

from voxmill.jobs import metrics_jobs, octree_jobs, points_jobs, scenes_jobs, source_jobs  # noqa: F401
from voxmill.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
