"""Projections, filters and boxes of point clouds.

All functions map a points table to a points table, row by row unless a box per cloud is needed; boxes
are aggregated with partial sums and joined back by broadcast only below the session's
threshold (the number of clouds is not bounded).
"""

from __future__ import annotations

from math import cos, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.clouds import meet
from voxmill.functions.keys import normalized
from voxmill.functions.ranks import ranked

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def orient_normal(points: DataFrame, axis: str) -> DataFrame:
    """Flip normals whose ``axis`` component is not positive; ``xyz`` takes absolute values."""
    if axis == "xyz":
        return points.withColumns({c: F.abs(c) for c in NORMAL})
    sign = F.when(F.col(f"n{axis}") > 0, 1.0).otherwise(-1.0)
    return points.withColumns({c: F.col(c) * sign for c in NORMAL})


def scale(points: DataFrame, factor: tuple[float, float, float]) -> DataFrame:
    """Multiply coordinates; with unequal factors normals are divided by them and renormalised."""
    if 0 in factor:
        raise ValueError("a scale factor is zero")
    if all(f == 1 for f in factor):
        return points
    out = {c: F.col(c) * F.lit(float(f)) for c, f in zip(XYZ, factor)}
    if len(set(factor)) > 1:
        out |= dict(zip(NORMAL, normalized(*[F.col(c) / F.lit(float(f)) for c, f in zip(NORMAL, factor)])))
    return points.withColumns(out)


def rotation(angle: tuple) -> list[list[Column]]:
    """The 3 x 3 product of turns about x, y and z, for row vectors; angles are numbers or columns."""
    fixed = all(isinstance(a, int | float) for a in angle)
    c, s = ([f(a) for a in angle] for f in ((cos, sin) if fixed else (F.cos, F.sin)))
    turn_x = [[1, 0, 0], [0, c[0], s[0]], [0, -s[0], c[0]]]
    turn_y = [[c[1], 0, -s[1]], [0, 1, 0], [s[1], 0, c[1]]]
    turn_z = [[c[2], s[2], 0], [-s[2], c[2], 0], [0, 0, 1]]
    product = lambda a, b: [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]
    return [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in product(product(turn_x, turn_y), turn_z)]


def rotate(points: DataFrame, angle: tuple) -> DataFrame:
    """Row vectors times the rotation, coordinates and normals alike."""
    m = rotation(angle)
    out = {}
    for names in (XYZ, NORMAL):
        for j, name in enumerate(names):
            out[name] = F.col(names[0]) * m[0][j] + F.col(names[1]) * m[1][j] + F.col(names[2]) * m[2][j]
    return points.withColumns(out)


def translate(points: DataFrame, d: tuple) -> DataFrame:
    return points.withColumns({c: F.col(c) + v for c, v in zip(XYZ, d)})


def flip(points: DataFrame, axes: str) -> DataFrame:
    return points.withColumns({n: -F.col(n) for a in axes for n in (a, f"n{a}")})


def inbox(low, high) -> Column:
    """Strictly inside the box on all axes; bounds are numbers or one for each axis."""
    low, high = ([v] * 3 if isinstance(v, int | float) else list(v) for v in (low, high))
    tests = [(F.col(c) > F.lit(float(a))) & (F.col(c) < F.lit(float(b))) for c, a, b in zip(XYZ, low, high)]
    return tests[0] & tests[1] & tests[2]


def inbox_mask(points: DataFrame, low, high, name: str = "inside") -> DataFrame:
    return points.withColumn(name, inbox(low, high))


def clip(points: DataFrame, low: float = -1.0, high: float = 1.0, margin: float = 0.01) -> DataFrame:
    return points.where(inbox(low + margin, high - margin))


def select_points(points: DataFrame, predicate: Column) -> DataFrame:
    return points.where(predicate)


def label_filter(points: DataFrame, mask: int) -> DataFrame:
    return points.where(F.col("label") > mask)


def bbox(points: DataFrame) -> DataFrame:
    """min_x .. max_z of each cloud."""
    return points.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ])


def with_bbox(points: DataFrame) -> DataFrame:
    return meet(points, bbox(points))


def centre(c: str) -> Column:
    return (F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5


def extent() -> Column:
    return F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ])


def _placed(points: DataFrame, values: dict[str, Column]) -> DataFrame:
    return with_bbox(points).withColumns(values).select(*points.columns)


def centralize_scale(points: DataFrame, size: float = 1.0) -> DataFrame:
    factor = F.lit(2.0 * size) / (extent() + 1e-6)
    return _placed(points, {c: (F.col(c) - centre(c)) * factor for c in XYZ})


def normalize_box(points: DataFrame, low, high, size: float) -> DataFrame:
    """(p - low) * size / the longest side."""
    low, high = ([float(v)] * 3 if isinstance(v, int | float) else list(v) for v in (low, high))
    side = max(b - a for a, b in zip(low, high))
    if side <= 0:
        raise ValueError("the box has no extent")
    return points.withColumns({c: (F.col(c) - F.lit(a)) * F.lit(size / side) for c, a in zip(XYZ, low)})


def preprocess_scene(points: DataFrame) -> DataFrame:
    """Indoor scans: centred in the box (z about 0.5), a tenth of 10.24 units; colours over 255."""
    moved = {c: (F.col(c) - (F.lit(0.5) if c == "z" else centre(c))) / 10.24 for c in XYZ}
    return _placed(points, moved | {"features": F.transform("features", lambda v: v / 255.0)})


def preprocess_lidar(points: DataFrame) -> DataFrame:
    """LiDAR sweeps: centred in the box, over 100."""
    return _placed(points, {c: (F.col(c) - centre(c)) / 100.0 for c in XYZ})


def preprocess_mesh_samples(points: DataFrame) -> DataFrame:
    return _placed(points, {c: (F.col(c) - centre(c)) / (extent() / 2 + 1e-6) for c in XYZ})


def preprocess_completion(points: DataFrame) -> DataFrame:
    factor = F.lit(2.0) / (extent() + 1e-6) * 0.95
    return _placed(points, {c: (F.col(c) - centre(c)) * factor for c in XYZ})


def preprocess_fixed_scale(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({c: F.col(c) / F.lit(float(size)) for c in XYZ})


def parse_alignment(lines: DataFrame) -> DataFrame:
    """cloud_id and m (16 numbers) from text lines ``axisAlignment = ...`` (cloud_id, line)."""
    numbers = F.split(F.trim(F.regexp_replace("line", r"^\s*axisAlignment\s*=", "")), r"\s+")
    return lines.where(F.col("line").rlike(r"^\s*axisAlignment\s*=")).select("cloud_id", F.transform(numbers, lambda v: v.cast("double")).alias("m"))


def align_axes(points: DataFrame, matrices: DataFrame) -> DataFrame:
    """p times the transposed rotation part plus the shift of each cloud's 4 x 4 matrix; without one p stays."""
    moved = {}
    for i, c in enumerate(XYZ):
        row = [F.element_at("m", 4 * i + j + 1) for j in range(4)]
        moved[c] = F.coalesce(F.col("x") * row[0] + F.col("y") * row[1] + F.col("z") * row[2] + row[3], F.col(c))
    return meet(points, matrices, how="left").withColumns(moved).select(*points.columns)


def merge_points(parts: list[DataFrame]) -> DataFrame:
    """One table of all clouds, numbered 0.. as ``batch_id`` in list order, then by cloud id."""
    both = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("part", F.lit(k)), allowMissingColumns=True)
    clouds = both.groupBy("part", "cloud_id").agg(F.count("*").alias("n_points"))
    block = F.struct("part", F.floor(F.col("cloud_id") / 4096))
    numbered = ranked(clouds, block, [F.col("part"), F.col("cloud_id")], name="batch_id")
    return meet(both, numbered, ("part", "cloud_id")).drop("part")


def split_counts(points: DataFrame, batches: int) -> DataFrame:
    """Points of each batch id from 0 to batches - 1, zeros included."""
    spine = points.sparkSession.range(batches).withColumnRenamed("id", "batch_id")
    return spine.join(points.groupBy("batch_id").agg(F.count("*").alias("n_points")), "batch_id", "left").select("batch_id", F.coalesce("n_points", F.lit(0)).alias("n_points"))


