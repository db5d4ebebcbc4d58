"""Look-ups of keys and points in octree levels: equi-joins on (cloud_id, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.keys import axis_steps, xyz_to_key, zeros
from voxmill.operators.octree import positions


def search_key(query: DataFrame, nodes: DataFrame, depth: int, nempty: bool = False) -> DataFrame:
    """``query`` (with cloud_id, key) plus ``idx``: the node's row position at ``depth``, or -1."""
    at = positions(nodes.where(F.col("depth") == depth), nempty).select("cloud_id", "key", "idx")
    return query.join(at, ["cloud_id", "key"], "left").withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


def search_xyz(query: DataFrame, nodes: DataFrame, depth: int, nempty: bool = False) -> DataFrame:
    """As ``search_key`` for coordinates x, y, z scaled to [0, 2 ** depth)."""
    return search_key(query.withColumn("key", xyz_to_key(F.col("x"), F.col("y"), F.col("z"), depth)), nodes, depth, nempty)


def align(feat: DataFrame, query: DataFrame, channels: int) -> DataFrame:
    """``query`` (cloud_id, key) plus ``data`` at the same key, zeros where there is none."""
    return query.join(feat.select("cloud_id", "key", "data"), ["cloud_id", "key"], "left").withColumn("data", F.coalesce("data", zeros(channels)))


def in_bounds(depth: int, *v: Column) -> Column:
    return reduce(lambda a, b: a & b, [(c >= 0) & (c < float(1 << depth)) for c in v])


def nearest(feat: DataFrame, query: DataFrame, depth: int, channels: int, bound_check: bool = True) -> DataFrame:
    """Feature of the cell that holds each query point (cloud_id, point_id, x, y, z scaled), else zeros."""
    xyz = [F.col(c) for c in "xyz"]
    key = xyz_to_key(*xyz, depth)
    asked = query.withColumn("key", F.when(in_bounds(depth, *xyz), key) if bound_check else key)
    return align(feat, asked, channels)


def _extent(depth: int, bound_check: bool) -> tuple[int, int]:
    """Bits and shift of places, which are named by their lower cell, with bounds by the cell after it: they start one cell outside and need one more bit."""
    return (depth + 1, 1) if bound_check else (depth, 0)


CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def cells_around(feat: DataFrame, depth: int, bound_check: bool = True) -> DataFrame:
    """(cloud_id, place, c0 .. c7): the features of the eight cells around each place between cells, null where there is no cell; channels that are null are zero."""
    bits, shift = _extent(depth, bound_check)
    steps = [axis_steps(F.col("key"), a, bits, wrap=True) for a in range(3)]
    parts = [[steps[a][1 + shift - o] for a, o in enumerate(at)] for at in CORNERS]
    places = F.array(*[F.struct(F.lit(n).alias("corner"), x.bitwiseOR(y).bitwiseOR(z).alias("place")) for n, (x, y, z) in enumerate(parts)])
    data = F.transform("data", lambda v: F.coalesce(v, F.lit(0.0))).alias("data")
    sent = feat.select("cloud_id", data, F.explode(places).alias("o")).select("cloud_id", "o.place", "o.corner", "data")
    return sent.groupBy("cloud_id", "place").agg(*[F.max(F.when(F.col("corner") == n, F.col("data"))).alias(f"c{n}") for n in range(8)])


def placed(query: DataFrame, depth: int, bound_check: bool = True) -> DataFrame:
    """(cloud_id, point_id, ix.., fx.., place): the place of each query point and where it lies between the cells there."""
    bits, shift = _extent(depth, bound_check)
    base = [F.floor(F.col(c) - 0.5) for c in "xyz"]
    asked = query.select("cloud_id", "point_id", *[b.cast("long").alias(f"i{c}") for b, c in zip(base, "xyz")], *[(F.col(c) - 0.5 - b).alias(f"f{c}") for b, c in zip(base, "xyz")])
    place = xyz_to_key(*[F.col(f"i{c}") + shift for c in "xyz"], bits)
    if bound_check:
        place = F.when(reduce(lambda a, b: a & b, [F.col(f"i{c}").between(-1, (1 << depth) - 1) for c in "xyz"]), place)
    return asked.withColumn("place", place)


def weighted(met: DataFrame, channels: int) -> DataFrame:
    """(cloud_id, point_id, data) of points that have met the cells around them.

    Cells that are not there become zeros first, and elements are taken by ``get``: so the sums of four channels stay below the 8000 bytes
    beyond which Java leaves a generated method uncompiled.
    """
    weights = [reduce(lambda a, b: a * b, [F.col(f"f{c}") if o else 1.0 - F.col(f"f{c}") for c, o in zip("xyz", at)]) for at in CORNERS]
    there = [F.when(F.col(f"c{n}").isNotNull(), w).otherwise(0.0).alias(f"w{n}") for n, w in enumerate(weights)]
    met = met.select("cloud_id", "point_id", *there, *[F.coalesce(f"c{n}", zeros(channels)).alias(f"c{n}") for n in range(8)])
    total = reduce(lambda a, b: a + b, [F.col(f"w{n}") for n in range(8)]) + 1e-12
    sums = [reduce(lambda a, b: a + b, [F.col(f"w{n}") * F.get(f"c{n}", F.lit(k)) for n in range(8)]) for k in range(channels)]
    return met.select("cloud_id", "point_id", F.array(*[s / total for s in sums]).alias("data"))


def linear(feat: DataFrame, query: DataFrame, depth: int, channels: int, bound_check: bool = True) -> DataFrame:
    """Trilinear feature over cell centres; weights of the cells found are scaled to one.

    (cloud_id, point_id, data). Without ``bound_check`` cells outside wrap to the far side. Points that meet no cell get zeros.
    Cells, of which there are fewer than points, are sent to the eight places between cells that they touch and put side by
    side there; a point then looks up its own place once. Points are not multiplied, and each row of ``query`` gives one row.
    """
    around = cells_around(feat, depth, bound_check).hint("merge")
    return weighted(placed(query, depth, bound_check).join(around, ["cloud_id", "place"], "left"), channels)


def interpolate(feat: DataFrame, query: DataFrame, depth: int, channels: int, method: str = "linear", low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Features at points given in [low, high]."""
    size = (1 << depth) / (high - low)
    scaled = query.withColumns({c: (F.col(c) - F.lit(low)) * F.lit(size) for c in "xyz"})
    return {"linear": linear, "nearest": nearest}[method](feat, scaled, depth, channels)


def combine(a: DataFrame, b: DataFrame, how: str = "concat") -> DataFrame:
    """Features of the nodes that both tables have, concatenated or added."""
    both = a.join(b.select("cloud_id", "depth", "key", F.col("data").alias("other")), ["cloud_id", "depth", "key"])
    data = F.concat("data", "other") if how == "concat" else F.zip_with("data", "other", lambda x, y: x + y)
    return both.withColumn("data", data).drop("other")
