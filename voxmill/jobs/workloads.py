"""The three workloads from end to end, and the hooks that users fill in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.operators import augment as A
from voxmill.operators import lookup, metrics, octree, scenes
from voxmill.operators import points as P

Step = Callable[[DataFrame], DataFrame]


def transform(points: DataFrame, preprocess: Step, params: DataFrame | None, depth: int, channels: int) -> DataFrame:
    """preprocess (a hook), augment, voxelize, average."""
    ready = points.transform(preprocess)
    ready = A.augment(ready, params) if params is not None else P.clip(ready)
    return octree.average_signal(octree.voxelize(ready, depth), channels)


def collate(voxels: DataFrame, order: DataFrame, depth: int, full_depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a batch and their neighbours: clouds renamed to their place (cloud_id, batch_idx) in the batch."""
    placed = voxels.join(order.select("cloud_id", F.col("batch_idx").cast("long").alias("__to")), "cloud_id").withColumn("cloud_id", F.col("__to")).drop("__to")
    nodes = octree.build_nodes(placed, depth, full_depth)
    return octree.merge_octrees(nodes), octree.neighbors(nodes, depth)


def score_scenes(logits: DataFrame, points: DataFrame, depth: int, classes: int) -> DataFrame:
    """Voxel logits (cloud_id, key, data) to points, softmax, argmax, IoU per cloud."""
    found = lookup.interpolate(logits, points, depth, classes, "linear")
    pred = found.select("cloud_id", "point_id", metrics.argmax(metrics.softmax(F.col("data"))).alias("pred"))
    return metrics.iou_per_shape(pred.join(points.select("cloud_id", "point_id", "label"), ["cloud_id", "point_id"]), classes)


def training_table(points: DataFrame, matrices: DataFrame, class_ids: DataFrame, crop: float, stride: float, least: int) -> DataFrame:
    """Scans aligned, labels remapped, cut into chunks, with a row number inside each chunk."""
    ready = scenes.remap_labels(P.align_axes(points, matrices), class_ids)
    chunks = scenes.assign_chunks(ready, crop, stride, least)
    rows = ready.join(chunks, ["cloud_id", "point_id"])
    return rows.withColumn("row_in_chunk", F.row_number().over(Window.partitionBy("cloud_id", "chunk_id").orderBy("point_id")) - 1)
