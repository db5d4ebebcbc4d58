"""Scenes: overlapping chunks and label tables. Class lists and label tables are joined without a hint: Spark broadcasts those whose size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.classes import LIDAR_CLASSES
from voxmill.functions.clouds import meet
from voxmill.operators.points import bbox


def assign_chunks(points: DataFrame, crop: float, stride: float, least: int) -> DataFrame:
    """(cloud_id, point_id, chunk_id): which overlapping boxes hold each point.

    Scenes smaller than ``crop`` on all axes are one chunk. Boxes start at the scene's lower corner plus whole strides and
    are closed; on an axis there are ceil(max(upper - crop, 0) / stride) + 1 of them. Boxes with under ``least``
    points are dropped and the others numbered in order of their x, y, z steps. A point's boxes follow
    from its position, so no box is compared with points.
    """
    boxes = bbox(points)
    small = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]) < crop
    count = {c: F.ceil(F.greatest(F.col(f"max_{c}") - crop, F.lit(0.0)) / stride) + 1 for c in "xyz"}
    placed = meet(points.select("cloud_id", "point_id", *"xyz"), boxes)
    for c in "xyz":
        offset = F.col(c) - F.col(f"min_{c}")
        first = F.greatest(F.ceil((offset - crop) / stride), F.lit(0).cast("long"))
        last = F.least(F.floor(offset / stride), count[c] - 1)
        steps = F.when(small, F.array(F.lit(0).cast("long"))).when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        placed = placed.withColumn(f"i{c}", F.explode(steps))
    ijk = ["cloud_id", "ix", "iy", "iz"]
    counts = placed.groupBy(*ijk).agg(F.count("*").alias("n"), F.first(small).alias("whole")).where(F.col("whole") | (F.col("n") >= least))
    numbered = counts.select(*ijk, (F.row_number().over(Window.partitionBy("cloud_id").orderBy("ix", "iy", "iz")) - 1).alias("chunk_id"))
    return placed.join(numbered, ijk).select("cloud_id", "point_id", "chunk_id")


def remap_labels(df: DataFrame, class_ids: DataFrame, name: str = "label") -> DataFrame:
    """Labels to their index in ``class_ids`` (class_id, index), others to 0."""
    table = class_ids.withColumnRenamed("class_id", name)
    return df.join(table, name, "left").withColumn(name, F.coalesce("index", F.lit(0))).drop("index")


def remap_lidar_labels(df: DataFrame, names: DataFrame) -> DataFrame:
    """The low 16 bits of ``label``, looked up in ``names`` (id, name), ``moving-`` taken off, to 1..19 or 0."""
    known = F.array_position(F.array(*[F.lit(c) for c in LIDAR_CLASSES]), F.regexp_replace("name", "moving-", ""))
    table = names.select(F.col("id").alias("__id"), known.cast("int").alias("__new"))
    low = F.col("label").cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    return df.join(table, low == F.col("__id"), "left").withColumn("label", F.coalesce("__new", F.lit(0))).drop("__id", "__new")


def shift_part_labels(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Labels minus their category's offset (category, shift)."""
    return df.join(offsets, "category").withColumn("label", F.col("label") - F.col("shift")).drop("shift")


def segment_labels(segments: DataFrame, groups: DataFrame, names: DataFrame, class_ids: DataFrame) -> DataFrame:
    """Labels of points from their segment's group.

    segments (scene, point_id, segment), groups (scene, position, label, segments ARRAY), names (row, raw_category, id),
    class_ids (class_id). The first row of a raw category counts, ids outside the class list are 0, later groups win over earlier
    ones, and points of unlisted segments get 0.
    """
    first = names.groupBy("raw_category").agg(F.min_by("id", "row").alias("id"))
    listed = class_ids.select(F.col("class_id").alias("id"), F.lit(True).alias("__known"))
    codes = first.join(listed, "id", "left").select(F.col("raw_category").alias("label"), F.when(F.col("__known"), F.col("id")).otherwise(0).alias("code"))
    marks = groups.select("scene", "position", "label", F.explode("segments").alias("segment")).join(codes, "label", "left")
    last = marks.groupBy("scene", "segment").agg(F.max_by(F.coalesce("code", F.lit(0)), "position").alias("code"))
    return segments.join(last, ["scene", "segment"], "left").select("scene", "point_id", "segment", F.coalesce("code", F.lit(0)).alias("label"))


def check_constant_column(df: DataFrame, scene: str, col: str) -> DataFrame:
    """How many values the column has in each scene, and whether it is constant."""
    return df.groupBy(scene).agg(F.count_distinct(col).alias("n_values")).withColumn("constant", F.col("n_values") <= 1)
