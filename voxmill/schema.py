"""Table schemas and the jobs that check tables.

Nulls: a missing attribute is a null column; coordinates must be present. Ids are not
assumed unique across clouds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = "cloud_id bigint, point_id bigint, x double, y double, z double, nx double, ny double, nz double, features array<double>, label int"
NODES = "cloud_id bigint, depth int, key bigint, nempty boolean, child bigint"
FEAT = "cloud_id bigint, depth int, key bigint, data array<double>"
VERTICES = "mesh_id bigint, vid bigint, x double, y double, z double"
FACES = "mesh_id bigint, fid bigint, v0 bigint, v1 bigint, v2 bigint"


def validate_points(points: DataFrame) -> DataFrame:
    """One row: rows, clouds, rows without coordinates, with half a normal, and repeated ids."""
    coords, normals = [F.col(c).isNull() for c in ("x", "y", "z")], [F.col(c).isNull().cast("int") for c in ("nx", "ny", "nz")]
    ids = points.groupBy("cloud_id", "point_id").agg(F.count("*").alias("n"), F.count_if(coords[0] | coords[1] | coords[2]).alias("no_xyz"), F.count_if((normals[0] + normals[1] + normals[2]).isin(1, 2)).alias("half_normal"))
    return ids.agg(F.sum("n").alias("n_points"), F.countDistinct("cloud_id").alias("n_clouds"), F.sum("no_xyz").alias("no_xyz"), F.sum("half_normal").alias("half_normal"), F.sum(F.col("n") - 1).alias("repeated_ids"))


def check_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: for each column how many values are NaN or infinite, and the largest magnitude of the others."""
    out = []
    for c in cols:
        v = F.col(c).cast("double")
        bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        out += [F.count_if(bad).alias(f"{c}_bad"), F.max(F.when(~bad, F.abs(v))).alias(f"{c}_max")]
    return df.agg(*out)
