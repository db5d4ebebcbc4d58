"""Seeded augmentation. Every random number is an md5 uniform of (seed, epoch, cloud, slot): reruns and other engines agree."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.clouds import meet
from voxmill.functions.keys import norm, uniform
from voxmill.functions.ranks import free
from voxmill.operators.points import NORMAL, XYZ, bbox, clip, rotation

#: Fixed value: the reference angle of half a turn.
HALF_TURN = 3.14159265


def draw(seed: int, slot: str) -> Column:
    return uniform(seed, F.col("epoch"), F.col("cloud_id"), F.lit(slot))


def augment_params(clouds: DataFrame, seed: int, epoch: int, angle: tuple, interval: tuple, scale: float, uniform_scale: bool, jitter: float, flip: tuple) -> DataFrame:
    """One row for each cloud: angles ax..az, factors sx..sz, shifts tx..tz, flips fx..fz.

    Angles are whole steps of ``interval`` degrees up to ``angle`` either way, factors lie in 1 +- scale,
    shifts in +- jitter, and an axis is flipped with its probability.
    """
    out = clouds.select("cloud_id", F.lit(epoch).alias("epoch"))
    for k, c in enumerate("xyz"):
        steps = angle[k] // interval[k] if interval[k] else 0
        step = F.floor(draw(seed, f"angle{k}") * (2 * steps + 1)) - steps
        out = out.withColumn(f"a{c}", step * float(interval[k]) * (HALF_TURN / 180.0))
        out = out.withColumn(f"s{c}", 1.0 + (draw(seed, f"scale{0 if uniform_scale else k}") * 2.0 - 1.0) * float(scale))
        out = out.withColumn(f"t{c}", (draw(seed, f"shift{k}") * 2.0 - 1.0) * float(jitter))
        out = out.withColumn(f"f{c}", draw(seed, f"flip{k}") < float(flip[k]))
    return out


def augment(points: DataFrame, params: DataFrame, orient: str | None = None) -> DataFrame:
    """Flip, rotate, shift, scale, orient normals, and clip to the unit cube, in this order."""
    cols = points.columns
    m = rotation(tuple(F.col(f"a{c}") for c in "xyz"))
    m = [[F.when(F.col(f"f{c}"), -v).otherwise(v) for v in row] for c, row in zip("xyz", m)]  # a flip is the sign of its row
    sure = lambda v, name: F.coalesce(v, F.lit(0.0)).alias(name)  # noqa: E731  never null, so no null filter drags the draws down to the points
    turns = params.select("cloud_id", *[sure(F.col(f"{p}{c}"), f"{p}{c}") for p in "st" for c in "xyz"], *[sure(m[i][j], f"m{i}{j}") for i in range(3) for j in range(3)])  # once a cloud
    same, length, *thin = free(points, "same", "length", "dx", "dy", "dz")
    even = (F.col("sx") == F.col("sy")) & (F.col("sy") == F.col("sz"))
    turns = turns.withColumns({same: even, **{d: F.when(even, 1.0).otherwise(F.col(f"s{c}")) for c, d in zip("xyz", thin)}})
    p = meet(points, turns)
    turned = {names[j]: F.col(names[0]) * F.col(f"m0{j}") + F.col(names[1]) * F.col(f"m1{j}") + F.col(names[2]) * F.col(f"m2{j}") for names in (XYZ, NORMAL) for j in range(3)}
    p = p.withColumns(turned)
    p = p.withColumns({**{c: (F.col(c) + F.col(f"t{c}")) * F.col(f"s{c}") for c in "xyz"}, **{n: F.col(n) / F.col(d) for n, d in zip(NORMAL, thin)}})
    p = p.withColumn(length, F.when(F.col(same), 1.0).otherwise(F.greatest(norm(*[F.col(n) for n in NORMAL]), F.lit(1e-12))))  # once a point: in branches it is worked out for each axis
    p = p.withColumns({n: F.col(n) / F.col(length) for n in NORMAL})
    if orient:
        sign = F.when(F.col(f"n{orient}") > 0, 1.0).otherwise(-1.0)
        p = p.withColumns({n: F.col(n) * sign for n in NORMAL})
    return clip(p).select(*cols)


def color_autocontrast(points: DataFrame, blend: DataFrame) -> DataFrame:
    """Colours (features 0..2 in 0..1) stretched to the cloud's full range, blended by each cloud's ``blend``."""
    low_high = [f(F.col("features")[k] * 255.0).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(3)]
    p = points.join(points.groupBy("cloud_id").agg(*low_high), "cloud_id").join(blend, "cloud_id")
    colors = []
    for k in range(3):
        c = F.col("features")[k] * 255.0
        stretched = (c - F.col(f"low{k}")) * (F.lit(255.0) / F.greatest(F.col(f"high{k}") - F.col(f"low{k}"), F.lit(1e-12)))
        colors.append((c * (1 - F.col("blend")) + stretched * F.col("blend")) / 255.0)
    return p.withColumn("features", F.array(*colors)).select(*points.columns)


def color_translate(points: DataFrame, shift: DataFrame) -> DataFrame:
    """Colours moved by each cloud's shift (r, g, b in 0..255), kept in range."""
    p = points.join(shift, "cloud_id")
    colors = [F.least(F.greatest(F.col("features")[k] * 255.0 + F.col(c), F.lit(0.0)), F.lit(255.0)) / 255.0 for k, c in enumerate("rgb")]
    return p.withColumn("features", F.array(*colors)).select(*points.columns)


def gaussian(seed: int, *parts: Column) -> Column:
    """A standard normal from two uniforms (Box-Muller)."""
    u = F.greatest(uniform(seed, *parts, F.lit("u")), F.lit(1e-12))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * pi) * uniform(seed, *parts, F.lit("v")))


def color_jitter(points: DataFrame, std: float, seed: int, prob: float = 0.95) -> DataFrame:
    """Gaussian noise of std * 255 on each colour of the clouds drawn with ``prob``."""
    drawn = uniform(seed, F.col("cloud_id")) < prob
    colors = []
    for k in range(3):
        noise = gaussian(seed, F.col("cloud_id"), F.col("point_id"), F.lit(k)) * (std * 255.0)
        c = F.col("features")[k] * 255.0
        colors.append(F.least(F.greatest(F.when(drawn, c + noise).otherwise(c), F.lit(0.0)), F.lit(255.0)) / 255.0)
    return points.withColumn("features", F.array(*colors))


def noise_lattice(points: DataFrame, granularity: float, seed: int) -> DataFrame:
    """Blurred noise (cloud_id, i, j, k, wx, wy, wz) on a lattice of extent // granularity + 3 nodes an axis."""
    box = bbox(points).select("cloud_id", *[(F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / granularity) + 3).alias(f"n{c}") for c in "xyz"])
    lattice = box
    for name, c in zip("ijk", "xyz"):
        lattice = lattice.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{c}") - 1)))
    lattice = lattice.select("cloud_id", *"ijk", *[gaussian(seed, F.col("cloud_id"), F.col("i"), F.col("j"), F.col("k"), F.lit(c)).alias(f"w{c}") for c in "xyz"])
    for _ in range(2):
        for axis in "ijk":
            w = Window.partitionBy("cloud_id", *[a for a in "ijk" if a != axis]).orderBy(axis).rowsBetween(-1, 1)
            lattice = lattice.select("cloud_id", *"ijk", *[(F.sum(f"w{c}").over(w) / 3.0).alias(f"w{c}") for c in "xyz"])
    return lattice


def elastic_distort(points: DataFrame, granularity: float, magnitude: float, seed: int) -> DataFrame:
    """Points moved by trilinear samples of blurred noise; outside the lattice nothing moves."""
    p = meet(points, bbox(points))
    at = {c: (F.col(c) - F.col(f"min_{c}")) / granularity + 1.0 for c in "xyz"}
    p = p.select("cloud_id", "point_id", *[at[c].alias(c) for c in "xyz"])
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    wide = p.select("*", F.explode(corners).alias("o"))
    weight = reduce(lambda a, b: a * b, [F.when(F.col(f"o.{c}") == 1, F.col(c) - F.floor(c)).otherwise(1 - F.col(c) + F.floor(c)) for c in "xyz"])
    probes = wide.select("cloud_id", "point_id", weight.alias("w"), *[(F.floor(c) + F.col(f"o.{c}")).alias(n) for c, n in zip("xyz", "ijk")])
    met = probes.join(noise_lattice(points, granularity, seed), ["cloud_id", *"ijk"])
    moves = met.groupBy("cloud_id", "point_id").agg(*[(F.sum(F.col("w") * F.col(f"w{c}")) * magnitude).alias(f"d{c}") for c in "xyz"])
    out = points.join(moves, ["cloud_id", "point_id"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xyz"}).select(*points.columns)


def resample_with_noise(points: DataFrame, n: int, std: float, seed: int, slots: int | None = None) -> DataFrame:
    """n draws with replacement from each cloud plus Gaussian noise: (cloud_id, draw, point_id, x, y, z).

    Points are ranked within hash slots of the cloud, and a draw's rank is looked up by slot, so that a huge cloud is
    ranked by many tasks. By default there are 64 slots and one more for each 65,536 points.
    """
    slots = slots or 64 + points.count() // 65_536
    slotted = points.withColumn("slot", F.pmod(F.col("point_id"), F.lit(slots)))
    counts = slotted.groupBy("cloud_id", "slot").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cloud_id").orderBy("slot")
    starts = counts.select("cloud_id", "slot", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("cloud_id")).alias("total"))
    ranked = slotted.withColumn("rn", F.row_number().over(Window.partitionBy("cloud_id", "slot").orderBy("point_id")) - 1).join(starts, ["cloud_id", "slot"])
    ranked = ranked.select("cloud_id", (F.col("start") + F.col("rn")).alias("rank"), "point_id", *XYZ)
    totals = starts.select("cloud_id", "total").distinct()
    draws = totals.select("cloud_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("draw"))
    draws = draws.withColumn("rank", F.floor(uniform(seed, F.col("cloud_id"), F.col("draw")) * F.col("total")).cast("long"))
    noise = {c: F.col(c) + gaussian(seed, F.col("cloud_id"), F.col("draw"), F.lit(c)) * std for c in XYZ}
    return draws.join(ranked, ["cloud_id", "rank"]).withColumns(noise).select("cloud_id", "draw", "point_id", *XYZ)


def shell_points(spark, resolution: int) -> DataFrame:
    """Integer cells x, y, z with R/2 - 1.25 <= distance to the centre <= R/2.

    For each (x, y) the two stretches of z follow from the radii, so the cube is never filled.
    """
    half = (resolution - 1) / 2.0
    plane = spark.range(resolution * resolution).select(F.expr(f"id div {resolution}").alias("x"), (F.col("id") % resolution).alias("y"))
    d = (F.col("x") - half) * (F.col("x") - half) + (F.col("y") - half) * (F.col("y") - half)
    outer, inner = (resolution / 2.0) ** 2 - d, (resolution / 2.0 - 1.25) ** 2 - d
    reach = plane.withColumn("outer", outer).withColumn("inner", inner).where("outer >= 0")
    span = F.sequence(F.greatest(F.floor(F.lit(half) - F.sqrt("outer")) - 1, F.lit(0).cast("long")), F.least(F.ceil(F.lit(half) + F.sqrt("outer")) + 1, F.lit(resolution - 1).cast("long")))
    hollow = F.greatest(F.sqrt(F.greatest("inner", F.lit(0.0))) - 1.5, F.lit(0.0))
    near = F.filter(span, lambda z: F.abs(z - half) >= hollow)
    wide = reach.select("x", "y", F.explode(near).alias("z"))
    r = norm(F.col("x") - half, F.col("y") - half, F.col("z") - half)
    return wide.where((r >= resolution / 2.0 - 1.25) & (r <= resolution / 2.0))
