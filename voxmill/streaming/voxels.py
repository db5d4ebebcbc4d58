"""Leaves of octrees and votes kept up to date as points arrive.

Counts and sums merge, so the same grouped aggregation runs as a Structured Streaming query: its state
is one row for each voxel seen, in the state store, and late points just add to their voxel. Run it in
``update`` mode into a sink that takes upserts by (cloud_id, key), or in ``complete`` mode for small trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxmill.operators.metrics import vote
from voxmill.operators.octree import average_signal, voxelize
from voxmill.operators.points import clip


def voxel_stream(points: DataFrame, depth: int, channels: int) -> DataFrame:
    """Averaged leaves of a stream (or table) of points."""
    return average_signal(voxelize(clip(points), depth), channels)


def vote_stream(pred: DataFrame, channels: int) -> DataFrame:
    """Summed probabilities of a stream (or table) of predictions."""
    return vote(pred, channels)
