"""Queries of meshes, scenes, listings and splits (R, J9-J12, A8, A9, W6, S7-S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.classes import PARTS, lidar_names, part_offsets, scene_classes
from voxmill.jobs.octree_jobs import uniform_sql
from voxmill.jobs.registry import query, r, rounded
from voxmill.jobs.tables import CLOUD_E, CLOUD_L, cloud_e, cloud_l, table
from voxmill.operators import mesh as M
from voxmill.operators import scenes as S
from voxmill.operators import splits as L


def vertices(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.expr("p_partkey div 100").alias("mesh_id"), k.alias("vid"), ((k % 100) / 50.0 - 1).alias("x"), (F.col("p_size") / 25.5 - 1).alias("y"), (((k * 7) % 13) / 6.5 - 1).alias("z"))


def faces(spark, d) -> DataFrame:
    v = vertices(spark, d).where(F.col("vid") % 100 < 98).select("mesh_id", F.col("vid").alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 2).alias("v2"))
    last = table(spark, d, "part").agg(F.max("p_partkey").alias("last"))
    return v.crossJoin(F.broadcast(last)).where("v2 <= last").drop("last")  # one row


VERTICES = "(SELECT p_partkey // 100 AS mesh_id, p_partkey AS vid, (p_partkey % 100) / 50.0::DOUBLE - 1 AS x, p_size / 25.5::DOUBLE - 1 AS y, ((p_partkey * 7) % 13) / 6.5::DOUBLE - 1 AS z FROM part)"
FACES = f"(SELECT mesh_id, vid AS fid, vid AS v0, vid + 1 AS v1, vid + 2 AS v2 FROM {VERTICES} WHERE vid % 100 < 98 AND vid + 2 <= (SELECT max(p_partkey) FROM part))"
_c = "".join(f" JOIN (SELECT mesh_id, vid AS v{k}, {', '.join(f'{c} AS {c}{k}' for c in 'xyz')} FROM {VERTICES}) USING (mesh_id, v{k})" for k in range(3))
_a, _b = [[f"({c}{k} - {c}0)" for c in "xyz"] for k in (1, 2)]
_cross = [f"{_a[1]} * {_b[2]} - {_a[2]} * {_b[1]}", f"{_a[2]} * {_b[0]} - {_a[0]} * {_b[2]}", f"{_a[0]} * {_b[1]} - {_a[1]} * {_b[0]}"]
GEOMETRY = f"(SELECT *, cx / l AS nx, cy / l AS ny, cz / l AS nz, l / 2 AS area FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) + 1e-8 AS l FROM (SELECT *, {', '.join(f'{e} AS c{n}' for e, n in zip(_cross, 'xyz'))} FROM {FACES}{_c})))"


@query("r5_face_geometry", f"SELECT mesh_id, fid, {r('nx', 'ny', 'nz', 'area')} FROM {GEOMETRY}")
def r5(spark, d):
    return M.face_geometry(vertices(spark, d), faces(spark, d)).select("mesh_id", "fid", *[rounded(c) for c in ("nx", "ny", "nz", "area")])


_parts = f"(SELECT mesh_id, unnest([v0, v1, v2]) AS vid, nx * area AS nx, ny * area AS ny, nz * area AS nz FROM {GEOMETRY})"
_sums = f"(SELECT mesh_id, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM {_parts} GROUP BY ALL)"


@query("r6_vertex_normals", f"SELECT mesh_id, vid, {r(*[f'coalesce(n{c} / (sqrt(nx * nx + ny * ny + nz * nz) + 1e-8), 0) AS n{c}' for c in 'xyz'])} FROM {VERTICES} LEFT JOIN {_sums} USING (mesh_id, vid)")
def r6(spark, d):
    return M.vertex_normals(vertices(spark, d), faces(spark, d)).select("mesh_id", "vid", *[rounded(c) for c in ("nx", "ny", "nz")])


N_DRAWS, SEED = 50, 11
DRAWS = f"(SELECT mesh_id, point_id, {', '.join(f'{uniform_sql(SEED, repr(n), 'mesh_id', 'point_id')} AS {n}' for n in 'ust')} FROM (SELECT DISTINCT mesh_id FROM {FACES}), range({N_DRAWS}) AS t(point_id))"
RUN = f"(SELECT mesh_id, fid, sum(area) OVER (PARTITION BY mesh_id ORDER BY fid) AS high, sum(area) OVER (PARTITION BY mesh_id ORDER BY fid) - area AS low, sum(area) OVER (PARTITION BY mesh_id) AS total FROM {GEOMETRY})"
PICKED = f"(SELECT d.mesh_id, d.point_id, min(fid) AS fid FROM {DRAWS} d JOIN {RUN} g ON d.mesh_id = g.mesh_id AND u * total >= low AND u * total < high GROUP BY ALL)"


@query("j9_sample_surface_pick", f"SELECT mesh_id, point_id, fid FROM {PICKED}")
def j9(spark, d):
    areas = M.face_geometry(vertices(spark, d), faces(spark, d)).select("mesh_id", "fid", "area")
    return M.pick_faces(M.draws(areas.select("mesh_id").distinct(), N_DRAWS, SEED), areas)


_at = [f"{c}0 + s2 * ({c}1 - {c}0) + t2 * ({c}2 - {c}0) AS {c}" for c in "xyz"]


@query("r7_sample_surface", f"SELECT mesh_id, point_id, fid, {r(*_at, 'nx', 'ny', 'nz')} FROM (SELECT *, CASE WHEN s + t > 1 THEN 1 - s ELSE s END AS s2, CASE WHEN s + t > 1 THEN 1 - t ELSE t END AS t2 FROM {PICKED} JOIN {DRAWS} USING (mesh_id, point_id)) JOIN {GEOMETRY} USING (mesh_id, fid)")
def r7(spark, d):
    return M.sample_surface(vertices(spark, d), faces(spark, d), N_DRAWS, SEED).select("mesh_id", "point_id", "fid", *[rounded(c) for c in ("x", "y", "z", "nx", "ny", "nz")])


CROP, STRIDE, LEAST = 0.9, 0.45, 12
_box = f"(SELECT cloud_id AS c, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}' for a in 'xyz')} FROM {CLOUD_L} GROUP BY cloud_id)"
_grid = f"(SELECT *, greatest(max_x - min_x, max_y - min_y, max_z - min_z) < {CROP} AS whole FROM {_box}, range(6) a(i), range(6) b(j), range(6) k(k) WHERE " + " AND ".join(f"{v} < ceil(greatest(max_{c} - {CROP}::DOUBLE, 0) / {STRIDE}::DOUBLE) + 1" for v, c in zip("ijk", "xyz")) + ")"
_met = f"(SELECT cloud_id, point_id, i, j, k FROM {CLOUD_L} JOIN {_grid} ON c = cloud_id AND " + " AND ".join(f"ceil(({c} - min_{c} - {CROP}::DOUBLE) / {STRIDE}::DOUBLE) <= {v} AND floor(({c} - min_{c}) / {STRIDE}::DOUBLE) >= {v}" for v, c in zip("ijk", "xyz")) + ")"
_kept = f"(SELECT cloud_id, i, j, k, row_number() OVER (PARTITION BY cloud_id ORDER BY i, j, k)::INT - 1 AS chunk_id FROM (SELECT cloud_id, i, j, k, count(*) AS n FROM {_met} GROUP BY ALL) WHERE n >= {LEAST})"


@query("j10_assign_chunks", f"SELECT cloud_id, point_id, chunk_id FROM {_met} JOIN {_kept} USING (cloud_id, i, j, k)")
def j10(spark, d):
    return S.assign_chunks(cloud_l(spark, d), CROP, STRIDE, LEAST)


KEPT = (1, 3, 4, 7, 9)


def class_ids(spark) -> DataFrame:
    return spark.createDataFrame([(c, k) for k, c in enumerate(KEPT, 1)], "class_id int, index int")


_index = "CASE label " + " ".join(f"WHEN {c} THEN {k}" for k, c in enumerate(KEPT, 1)) + " ELSE 0 END"


@query("r1_remap_labels", f"SELECT cloud_id, point_id, {_index} AS label FROM {CLOUD_E}")
def r1(spark, d):
    return S.remap_labels(cloud_e(spark, d), class_ids(spark)).select("cloud_id", "point_id", "label")


RAW = "((l_partkey % 300) + (l_suppkey << 16))"
#: Raw labels and what becomes of them, typed in by hand: nothing here is taken from the library's tables.
_lidar = """CASE l_partkey % 300 WHEN 40 THEN 1 WHEN 48 THEN 2 WHEN 44 THEN 3 WHEN 49 THEN 4 WHEN 50 THEN 5 WHEN 10 THEN 6 WHEN 252 THEN 6 WHEN 18 THEN 7 WHEN 258 THEN 7
 WHEN 11 THEN 8 WHEN 15 THEN 9 WHEN 20 THEN 10 WHEN 259 THEN 10 WHEN 70 THEN 11 WHEN 71 THEN 12 WHEN 72 THEN 13 WHEN 30 THEN 14 WHEN 254 THEN 14
 WHEN 31 THEN 15 WHEN 253 THEN 15 WHEN 32 THEN 16 WHEN 255 THEN 16 WHEN 51 THEN 17 WHEN 80 THEN 18 WHEN 81 THEN 19 ELSE 0 END"""


@query("r2_remap_lidar_labels", f"SELECT {RAW} AS raw, {_lidar} AS label FROM lineitem")
def r2(spark, d):
    raw = table(spark, d, "lineitem").select((F.col("l_partkey") % 300 + F.shiftleft("l_suppkey", 16)).alias("raw")).withColumn("label", F.col("raw"))
    return S.remap_lidar_labels(raw, lidar_names(spark)).select("raw", "label")


@query("r1_remap_scene_labels", f"SELECT l_orderkey AS row_id, coalesce(position, 0) AS label FROM lineitem LEFT JOIN (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10), (11, 11), (12, 12), (14, 13), (16, 14), (24, 15), (28, 16), (33, 17), (34, 18), (36, 19), (39, 20)) AS c(id, position) ON id = l_partkey % 45")
def r1b(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % 45).cast("int").alias("label"))
    return S.remap_labels(raw, scene_classes(spark)).select("row_id", "label")


_shifts = "(VALUES (0, 'Aero', 0), (1, 'Bag', 4), (2, 'Cap', 6), (3, 'Car', 8), (4, 'Chair', 12), (5, 'EarPhone', 16), (6, 'Guitar', 19), (7, 'Knife', 22), (8, 'Lamp', 24), (9, 'Laptop', 28), (10, 'Motor', 30), (11, 'Mug', 36), (12, 'Pistol', 38), (13, 'Rocket', 41), (14, 'Skate', 44), (15, 'Table', 47)) AS s(n, category, shift)"


@query("r3_shift_shape_parts", f"SELECT l_orderkey AS row_id, category, l_suppkey - shift AS label FROM lineitem JOIN {_shifts} ON n = l_partkey % 16")
def r3b(spark, d):
    names = F.get(F.array(*[F.lit(n) for n in PARTS]), (F.col("l_partkey") % 16).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), names.alias("category"), F.col("l_suppkey").alias("label"))
    return S.shift_part_labels(rows, part_offsets(spark)).select("row_id", "category", "label")


@query("r3_shift_part_labels", f"SELECT cloud_id AS category, point_id, label + 40 - cloud_id * 5 AS label FROM {CLOUD_L}")
def r3(spark, d):
    offsets = cloud_l(spark, d).select(F.col("cloud_id").alias("category")).distinct().withColumn("shift", F.col("category") * 5 - 40)
    return S.shift_part_labels(cloud_l(spark, d).select(F.col("cloud_id").alias("category"), "point_id", F.col("label").cast("long").alias("label")), offsets).select("category", "point_id", "label")


SEGMENT = "(SELECT user_id % 8 AS scene, event_id AS point_id, json_extract(props, '$.k')::BIGINT AS segment FROM events)"
#: Groups of the query: position, raw category and the segments it lists, the same in every scene.
GROUPS = [(0, "chair", (1, 2, 3, 10)), (1, "table", (3, 4, 5)), (2, "unknown", (6, 7)), (3, "wall", (10, 11, 12, 13))]
NAMES = [(0, "chair", 3), (1, "chair", 4), (2, "table", 7), (3, "wall", 2)]
_marks = "(VALUES " + ", ".join(f"({p}, {seg}, {next((i for _, n, i in NAMES if n == name and i in KEPT), 0)})" for p, name, segs in GROUPS for seg in segs) + ") AS m(position, segment, code)"


def segments(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("scene"), F.col("event_id").alias("point_id"), F.get_json_object("props", "$.k").cast("long").alias("segment"))


@query("r4_segment_labels", f"SELECT scene, point_id, segment, coalesce(code, 0) AS label FROM {SEGMENT} LEFT JOIN (SELECT segment, arg_max(code, position) AS code FROM {_marks} GROUP BY segment) USING (segment)")
def r4(spark, d):
    s = segments(spark, d)
    shape = spark.createDataFrame([(p, n, list(x)) for p, n, x in GROUPS], "position int, label string, segments array<bigint>")
    groups = s.select("scene").distinct().crossJoin(F.broadcast(shape))  # four rows
    names = spark.createDataFrame(NAMES, "row int, raw_category string, id int")
    return S.segment_labels(s, groups, names, class_ids(spark))


@query("r14_check_constant_column", "SELECT user_id % 8 AS scene, count(DISTINCT event_type) AS n_values, count(DISTINCT event_type) <= 1 AS constant FROM events GROUP BY 1")
def r14(spark, d):
    return S.check_constant_column(table(spark, d, "events").withColumn("scene", F.col("user_id") % 8), "scene", "event_type")


# ---------------------------------------------------------------- listings

FILES = "(SELECT source AS category, lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)"


def files(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.col("source").alias("category"), F.lpad(i.cast("string"), 9, "0").alias("name"), i, F.when(i % 5 == 0, "test").otherwise("train").alias("split"))


def partners(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), "doc_id", "toxic")


PARTNERS = "(SELECT lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id, toxic FROM labels)"


@query("r8_class_index", f"SELECT name, category, dense_rank() OVER (ORDER BY category)::INT - 1 AS category_id FROM {FILES}")
def r8(spark, d):
    return L.class_index(files(spark, d)).select("name", "category", "category_id")


RATIOS = [0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0]


@query("r9_ratio_split", f"SELECT ratio::DOUBLE AS ratio, category, split, name FROM (SELECT *, row_number() OVER (PARTITION BY category, split ORDER BY name) AS rn, count(*) OVER (PARTITION BY category, split) AS n FROM {FILES}), (VALUES {', '.join(f'({x}::DOUBLE)' for x in RATIOS)}) AS t(ratio) WHERE rn <= ceil(n * ratio)")
def r9(spark, d):
    return L.ratio_split(files(spark, d), RATIOS, F.substring("name", 1, 6))


@query("r10_sequence_split", f"WITH t AS (SELECT name, doc_id % 22 AS sequence, CASE WHEN doc_id % 22 = 8 THEN 'val' WHEN doc_id % 22 < 11 THEN 'train' ELSE 'test' END AS split FROM {FILES}) SELECT * FROM t UNION ALL SELECT name, sequence, 'train_val' FROM t WHERE split <> 'test'")
def r10(spark, d):
    sequences = spark.createDataFrame([(k, "val" if k == 8 else "train" if k < 11 else "test") for k in range(22)], "sequence long, split string")
    return L.sequence_split(files(spark, d).select("name", (F.col("doc_id") % 22).alias("sequence")), sequences)


_lists = f"(SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS list, doc_id AS position, category, category || '/' || name AS line FROM {FILES})"


@query("r11_category_filelists", f"SELECT CASE WHEN list = 'test' THEN 'test' ELSE 'train_val' END AS list, category, CASE list WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS part, position, line || ' ' || (dense_rank() OVER (ORDER BY category) - 1) AS line FROM {_lists} WHERE category IS NOT NULL")
def r11(spark, d):
    i = F.col("doc_id")
    f = files(spark, d)
    lines = f.select(F.when(i % 3 == 0, "train").when(i % 3 == 1, "val").otherwise("test").alias("list"), i.alias("position"), F.concat(F.lit("data/"), "category", F.lit("/"), "name").alias("line"))
    return L.category_filelists(lines, L.class_index(f.where("category is not null")).select("category", "category_id").distinct())


@query("j11_match_listings", f"SELECT category, name FROM {FILES} WHERE name IN (SELECT name FROM {PARTNERS})")
def j11(spark, d):
    return L.match_listings(files(spark, d), partners(spark, d), ["name"]).select("category", "name")


@query("j12_drop_listed", f"SELECT category, name FROM {FILES} WHERE name NOT IN (SELECT name FROM {PARTNERS} WHERE toxic = 1)")
def j12(spark, d):
    return L.drop_listed(files(spark, d), partners(spark, d).where("toxic = 1"), ["name"]).select("category", "name")


@query("r12_holdout_split", f"SELECT category, name, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY name) <= floor(count(*) OVER (PARTITION BY category) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {FILES} WHERE name IN (SELECT name FROM {PARTNERS})")
def r12(spark, d):
    return L.holdout_split(files(spark, d), partners(spark, d), 0.8, F.substring("name", 1, 6))


@query("r13_rewrite_suffix", f"SELECT replace(category || '/' || name || '.points', '.points', '.npz') AS line FROM {FILES}")
def r13(spark, d):
    return L.rewrite_suffix(files(spark, d).select(F.concat("category", F.lit("/"), "name", F.lit(".points")).alias("line")), ".points", ".npz")


@query("a8_take", f"SELECT name FROM {FILES} ORDER BY name LIMIT (SELECT ceil(count(*) * 0.3::DOUBLE)::BIGINT FROM documents)")
def a8(spark, d):
    f = files(spark, d)
    return L.take(f, f.count(), 0.3, "name", F.substring("name", 1, 6)).select("name")


@query("a9_assign_batches", "SELECT c AS cloud_id, (rk // 3)::BIGINT AS batch, (rk % 3)::INT AS batch_idx FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || c), c) - 1 AS rk FROM (SELECT DISTINCT label::BIGINT AS c FROM embeddings))")
def a9(spark, d):
    return L.assign_batches(cloud_e(spark, d).select("cloud_id").distinct(), 3, 7)


@query("w6_union_listings", f"SELECT name FROM {FILES} UNION ALL SELECT name FROM {PARTNERS}")
def w6(spark, d):
    return L.union_listings(files(spark, d).select("name"), partners(spark, d).select("name"))


@query("w6_intersect_listings", f"SELECT name FROM {FILES} INTERSECT SELECT name FROM {PARTNERS}")
def w6b(spark, d):
    return L.intersect_listings(files(spark, d), partners(spark, d))
