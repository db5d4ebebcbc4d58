"""Triangle meshes: normals and surface samples.

Vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, v0, v1, v2). Running areas are summed in
blocks of face ids first, so that one huge mesh is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.keys import norm, uniform

#: Faces in a block of the running areas.
FACES = 4096
#: Slots of a face that one row lists.
SLOTS = 4096


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates x0 .. z2."""
    out = faces
    for k in range(3):
        at = vertices.select("mesh_id", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        out = out.join(at, ["mesh_id", f"v{k}"])
    return out


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Corners, unit normal (nx, ny, nz) and area: the cross product's length gets 1e-8 before either."""
    c = corners(vertices, faces)
    a, b = [[F.col(f"{n}{k}") - F.col(f"{n}0") for n in "xyz"] for k in (1, 2)]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = c.withColumns({f"c{n}": v for n, v in zip("xyz", cross)})
    length = norm(F.col("cx"), F.col("cy"), F.col("cz")) + 1e-8
    return c.withColumns({**{f"n{n}": F.col(f"c{n}") / length for n in "xyz"}, "area": length / 2.0}).drop("cx", "cy", "cz")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area-weighted sums of the normals of a vertex's faces, scaled to length one; zero for isolated ones."""
    parts = face_geometry(vertices, faces).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(F.col(f"n{n}") * F.col("area")).alias(f"n{n}") for n in "xyz"])
    sums = parts.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{n}").alias(f"n{n}") for n in "xyz"])
    length = norm(F.col("nx"), F.col("ny"), F.col("nz")) + 1e-8
    units = sums.select("mesh_id", "vid", *[(F.col(f"n{n}") / length).alias(f"n{n}") for n in "xyz"])
    return vertices.join(units, ["mesh_id", "vid"], "left").fillna(0.0, [f"n{n}" for n in "xyz"])


def running_area(areas: DataFrame) -> DataFrame:
    """(mesh_id, fid, area) plus ``low``, ``high`` (the running sum before and after), ``total`` and ``n_faces``, in id order."""
    blocked = areas.withColumn("block", F.expr(f"fid div {FACES}"))
    sums = blocked.groupBy("mesh_id", "block").agg(F.sum("area").alias("block_area"), F.count("*").alias("block_faces"))
    whole = Window.partitionBy("mesh_id")
    before = F.coalesce(F.sum("block_area").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select("mesh_id", "block", before.alias("start"), F.sum("block_area").over(whole).alias("total"), F.sum("block_faces").over(whole).alias("n_faces"))
    within = F.sum("area").over(Window.partitionBy("mesh_id", "block").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocked.withColumn("within", within).join(starts, ["mesh_id", "block"])
    return ranked.withColumn("high", F.col("start") + F.col("within")).withColumn("low", F.col("high") - F.col("area")).drop("block", "within", "start")


def pick_faces(draws: DataFrame, areas: DataFrame) -> DataFrame:
    """Draws (mesh_id, point_id, u) with the face whose stretch of the running area holds u * total.

    An as-of join made an equi-join: the area axis of each mesh is cut into as many slots as it has faces, a face is listed in
    the slots it reaches (in all, less than twice as many rows as faces), and a draw looks into its own.
    """
    run = running_area(areas)
    sizes = areas.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    slot = lambda v: F.least(F.floor(v / F.col("total") * F.col("n_faces")), F.col("n_faces") - 1).cast("long")
    # a face with most of the area is listed in most slots: in runs of SLOTS, so that no row holds them all
    reached = run.select("mesh_id", "fid", "low", "high", "total", slot(F.col("low")).alias("from"), slot(F.col("high")).alias("to"))
    runs = reached.withColumn("run", F.explode(F.sequence(F.expr(f"`from` div {SLOTS}"), F.expr(f"`to` div {SLOTS}"))))
    own = F.sequence(F.greatest("from", F.col("run") * SLOTS), F.least("to", F.col("run") * SLOTS + (SLOTS - 1)))
    listed = runs.select("mesh_id", "fid", "low", "high", "total", F.explode(own).alias("slot"))
    asked = draws.join(sizes, "mesh_id").withColumn("slot", F.floor(F.col("u") * F.col("n_faces")).cast("long"))
    met = asked.join(listed, ["mesh_id", "slot"]).where((F.col("u") * F.col("total") >= F.col("low")) & (F.col("u") * F.col("total") < F.col("high")))
    return met.groupBy("mesh_id", "point_id").agg(F.min("fid").alias("fid"))


def draws(meshes: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws (mesh_id, point_id, u, s, t) for each mesh, from its id and the seed."""
    rows = meshes.select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("point_id"))
    return rows.select("*", *[uniform(seed, F.lit(name), F.col("mesh_id"), F.col("point_id")).alias(name) for name in ("u", "s", "t")])


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int, seed: int) -> DataFrame:
    """n points for each mesh, uniform over its area, with the face and its normal."""
    geometry = face_geometry(vertices, faces)
    wanted = draws(faces.select("mesh_id").distinct(), n, seed)
    picked = pick_faces(wanted, geometry.select("mesh_id", "fid", "area")).join(wanted, ["mesh_id", "point_id"])
    over = F.col("s") + F.col("t") > 1
    s, t = F.when(over, 1 - F.col("s")).otherwise(F.col("s")), F.when(over, 1 - F.col("t")).otherwise(F.col("t"))
    at = [F.col(f"{c}0") + s * (F.col(f"{c}1") - F.col(f"{c}0")) + t * (F.col(f"{c}2") - F.col(f"{c}0")) for c in "xyz"]
    return picked.join(geometry, ["mesh_id", "fid"]).select("mesh_id", "point_id", "fid", *[v.alias(c) for v, c in zip(at, "xyz")], "nx", "ny", "nz")
