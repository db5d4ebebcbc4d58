"""Queries of augmentation, sources and workloads (A1-A7, S, U, W4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.ranks import ranked
from voxmill.jobs import scenes_jobs, workloads
from voxmill.jobs.octree_jobs import neigh_sql, uniform_sql
from voxmill.jobs.points_jobs import alignments
from voxmill.jobs.registry import query, r, rounded
from voxmill.jobs.tables import CLIPPED, CLOUD_E, CLOUD_L, DEPTH, FULL, INSIDE, cloud_e, cloud_l, clipped, feat, folder, keyed_sql, table
from voxmill.operators import augment as A
from voxmill.operators import octree as O
from voxmill.operators import points as P
from voxmill.sources import files as S


# ---------------------------------------------------------------- augmentation

EPOCH, SEED = 3, 17


def params(spark, d, uniform_scale=True) -> DataFrame:
    return A.augment_params(cloud_l(spark, d).select("cloud_id").distinct(), SEED, EPOCH, (10, 10, 180), (5, 5, 1), 0.25, uniform_scale, 0.1, (0.5, 0.0, 0.5))


def _u(slot: str) -> str:
    return uniform_sql(SEED, str(EPOCH), "cloud_id", f"'{slot}'")


def params_sql(uniform_scale: bool = True) -> str:
    out = []
    for k, c in enumerate("xyz"):
        steps = (10 // 5, 10 // 5, 180)[k]
        out += [f"(floor({_u(f'angle{k}')} * {2 * steps + 1}) - {steps}) * {(5.0, 5.0, 1.0)[k]}::DOUBLE * ({A.HALF_TURN}::DOUBLE / 180) AS a{c}", f"1 + ({_u(f'scale{0 if uniform_scale else k}')} * 2 - 1) * 0.25::DOUBLE AS s{c}", f"({_u(f'shift{k}')} * 2 - 1) * 0.1::DOUBLE AS t{c}", f"{_u(f'flip{k}')} < {(0.5, 0.0, 0.5)[k]}::DOUBLE AS f{c}"]
    return f"(SELECT cloud_id, {EPOCH} AS epoch, {', '.join(out)} FROM (SELECT DISTINCT cloud_id FROM {CLOUD_L}))"


@query("a1_augment_params", f"SELECT cloud_id, epoch, {r(*[f'{p}{c}' for c in 'xyz' for p in 'ast'])}, fx, fy, fz FROM {params_sql()}")
def a1(spark, d):
    return params(spark, d).select("cloud_id", "epoch", *[rounded(f"{p}{c}") for c in "xyz" for p in "ast"], "fx", "fy", "fz")


_flip = [f"CASE WHEN f{c} THEN -{n} ELSE {n} END AS {n}" for c in "xyz" for n in (c, f"n{c}")]
_m = [["cy * cz", "cy * sz", "-sy"], ["(sx_ * sy * cz - cx * sz)", "(sx_ * sy * sz + cx * cz)", "sx_ * cy"], ["(cx * sy * cz + sx_ * sz)", "(cx * sy * sz - sx_ * cz)", "cx * cy"]]
_trig = "sin(ax) AS sx_, cos(ax) AS cx, sin(ay) AS sy, cos(ay) AS cy, sin(az) AS sz, cos(az) AS cz"
_turn = [" + ".join(f"{n} * {_m[i][j]}" for i, n in enumerate(names)) + f" AS {names[j]}" for names in (("x", "y", "z"), ("nx", "ny", "nz")) for j in range(3)]
_thin = "greatest(sqrt((nx/kx)*(nx/kx) + (ny/ky)*(ny/ky) + (nz/kz)*(nz/kz)), 1e-12)"


def augmented_sql(source: str, p: str) -> str:
    """Points flipped, turned, moved and scaled by the parameters p."""
    p2 = f"(SELECT cloud_id, ax, ay, az, sx AS kx, sy AS ky, sz AS kz, tx, ty, tz, fx, fy, fz FROM {p})"
    s1 = f"(SELECT cloud_id, point_id, {', '.join(_flip)}, {_trig}, kx, ky, kz, tx, ty, tz FROM {source} JOIN {p2} USING (cloud_id))"
    s2 = f"(SELECT cloud_id, point_id, {', '.join(_turn)}, kx, ky, kz, tx, ty, tz FROM {s1})"
    return f"(SELECT cloud_id, point_id, {', '.join(f'({c} + t{c}) * k{c} AS {c}' for c in 'xyz')}, {', '.join(f'n{c} / k{c} / {_thin} AS n{c}' for c in 'xyz')} FROM {s2})"


@query("a2_augment", f"SELECT cloud_id, point_id, {r('x', 'y', 'z', 'nx', 'ny', 'nz')} FROM {augmented_sql(CLOUD_L, params_sql(False))} WHERE {INSIDE}")
def a2(spark, d):
    return A.augment(cloud_l(spark, d), params(spark, d, False)).select("cloud_id", "point_id", *[rounded(c) for c in ("x", "y", "z", "nx", "ny", "nz")])


def coloured(spark, d) -> DataFrame:
    """Cloud E with colours in 0..1 from its features."""
    return cloud_e(spark, d).withColumn("features", F.array(*[F.abs(F.col("features")[k]) * 1.5 for k in range(3)]))


COLOURED = f"(SELECT cloud_id, point_id, {', '.join(f'abs(f{k}) * 1.5::DOUBLE AS c{k}' for k in range(3))} FROM {CLOUD_E})"


def colours(df: DataFrame) -> DataFrame:
    return df.select("cloud_id", "point_id", *[rounded(F.col("features")[k], f"c{k}") for k in range(3)])


_b = "(cloud_id::DOUBLE / 10)"
_auto = [f"(c{k} * 255 * (1 - {_b}) + (c{k} * 255 - min(c{k} * 255) OVER w) * (255 / greatest(max(c{k} * 255) OVER w - min(c{k} * 255) OVER w, 1e-12)) * {_b}) / 255 AS c{k}" for k in range(3)]


@query("a3_color_autocontrast", f"SELECT cloud_id, point_id, {r(*_auto)} FROM {COLOURED} WINDOW w AS (PARTITION BY cloud_id)")
def a3(spark, d):
    c = coloured(spark, d)
    return colours(A.color_autocontrast(c, c.select("cloud_id").distinct().select("cloud_id", (F.col("cloud_id") / 10).alias("blend"))))


@query("a4_color_translate", f"SELECT cloud_id, point_id, {r(*[f'least(greatest(c{k} * 255 + (cloud_id - 5) * {k + 4}, 0), 255) / 255 AS c{k}' for k in range(3)])} FROM {COLOURED}")
def a4(spark, d):
    c = coloured(spark, d)
    shift = c.select("cloud_id").distinct().select("cloud_id", *[((F.col("cloud_id") - 5) * (k + 4)).cast("double").alias(n) for k, n in enumerate("rgb")])
    return colours(A.color_translate(c, shift))


def gaussian_sql(seed: int, *parts: str) -> str:
    u, v = (uniform_sql(seed, *parts, f"'{n}'") for n in "uv")
    return f"(sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * pi() * {v}))"


_drawn = f"{uniform_sql(23, 'cloud_id')} < 0.95::DOUBLE"


_jitter = [f"least(greatest(c{k} * 255 + CASE WHEN {_drawn} THEN {gaussian_sql(23, 'cloud_id', 'point_id', str(k))} * (0.05 * 255)::DOUBLE ELSE 0 END, 0), 255) / 255 AS c{k}" for k in range(3)]


@query("a5_color_jitter", f"SELECT cloud_id, point_id, {r(*_jitter)} FROM {COLOURED}")
def a5(spark, d):
    return colours(A.color_jitter(coloured(spark, d), 0.05, 23))


GRAIN, PUSH = 0.3, 0.4
_box = f"(SELECT cloud_id, {', '.join(f'min({c}) AS min_{c}, floor((max({c}) - min({c})) / {GRAIN}::DOUBLE) + 3 AS n{c}' for c in 'xyz')} FROM {CLOUD_E} GROUP BY cloud_id)"
_noise = f"(SELECT cloud_id, i, j, k, {', '.join(gaussian_sql(29, 'cloud_id', 'i', 'j', 'k', chr(39) + c + chr(39)) + f' AS w{c}' for c in 'xyz')} FROM {_box}, range(40) a(i), range(40) b(j), range(40) c(k) WHERE i < nx AND j < ny AND k < nz)"
for _ in range(2):
    for _axis in "ijk":
        _others = ", ".join(a for a in "ijk" if a != _axis)
        _noise = f"(SELECT cloud_id, i, j, k, {', '.join(f'sum(w{c}) OVER w / 3 AS w{c}' for c in 'xyz')} FROM {_noise} WINDOW w AS (PARTITION BY cloud_id, {_others} ORDER BY {_axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
_probe = f"(SELECT cloud_id, point_id, {', '.join(f'({c} - min_{c}) / {GRAIN}::DOUBLE + 1 AS {c}' for c in 'xyz')} FROM {CLOUD_E} JOIN {_box} USING (cloud_id))"
_w = " * ".join(f"CASE WHEN o{c} = 1 THEN {c} - floor({c}) ELSE 1 - {c} + floor({c}) END" for c in "xyz")
_probes = f"(SELECT cloud_id, point_id, {_w} AS w, {', '.join(f'(floor({c}) + o{c})::BIGINT AS {n}' for c, n in zip('xyz', 'ijk'))} FROM {_probe}, range(2) a(ox), range(2) b(oy), range(2) c(oz))"
_moves = f"(SELECT cloud_id, point_id, {', '.join(f'sum(w * w{c}) * {PUSH}::DOUBLE AS d{c}' for c in 'xyz')} FROM {_probes} JOIN {_noise} USING (cloud_id, i, j, k) GROUP BY cloud_id, point_id)"


@query("a6_elastic_distort", f"SELECT cloud_id, point_id, {r(*[f'{c} + coalesce(d{c}, 0) AS {c}' for c in 'xyz'])} FROM {CLOUD_E} LEFT JOIN {_moves} USING (cloud_id, point_id)")
def a6(spark, d):
    return A.elastic_distort(cloud_e(spark, d), GRAIN, PUSH, 29).select("cloud_id", "point_id", *[rounded(c) for c in "xyz"])


_ranked = f"(SELECT cloud_id, point_id, x, y, z, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id % 64, point_id) - 1 AS rank, count(*) OVER (PARTITION BY cloud_id) AS total FROM {CLOUD_E})"
_draws = f"(SELECT cloud_id, draw, floor({uniform_sql(31, 'cloud_id', 'draw')} * total)::BIGINT AS rank FROM (SELECT DISTINCT cloud_id, total FROM {_ranked}), range(200) AS t(draw))"


@query("a7_resample_with_noise", f"SELECT cloud_id, draw, point_id, {r(*[c + ' + ' + gaussian_sql(31, 'cloud_id', 'draw', chr(39) + c + chr(39)) + f' * 0.01::DOUBLE AS {c}' for c in 'xyz'])} FROM {_draws} JOIN {_ranked} USING (cloud_id, rank)")
def a7(spark, d):
    return A.resample_with_noise(cloud_e(spark, d), 200, 0.01, 31, slots=64).select("cloud_id", "draw", "point_id", *[rounded(c) for c in "xyz"])


# the shells are scaled by the number of parts, so that the work follows the tables
@query("w4_shell_points", "SELECT x, y, z FROM (SELECT (ceil(log2(count(*)) / 3) + 3)::INT AS d FROM part), LATERAL (SELECT 1 << d AS r), range(256) a(x), range(256) b(y), range(256) c(z) WHERE x < r AND y < r AND z < r AND sqrt((x - (r - 1) / 2.0::DOUBLE) ** 2 + (y - (r - 1) / 2.0::DOUBLE) ** 2 + (z - (r - 1) / 2.0::DOUBLE) ** 2) BETWEEN r / 2.0::DOUBLE - 1.25 AND r / 2.0::DOUBLE")
def w4(spark, d):
    n = table(spark, d, "part").count()
    return A.shell_points(spark, 1 << (int(np.ceil(np.log2(n) / 3)) + 3))


# ---------------------------------------------------------------- sources

def stored(spark, d, form: str) -> DataFrame:
    """Cloud L written as files of that form and read back as (path, content)."""
    path = folder(spark)
    S.save_files(S.packed_clouds(cloud_l(spark, d), form, "PNL", rows=8_192), path)
    return S.binary_files(spark, path)


READ = f"SELECT {r('x', 'y', 'z', 'nx', 'ny', 'nz')}, label FROM {CLOUD_L}"


def read_back(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c) for c in ("x", "y", "z", "nx", "ny", "nz")], "label")


@query("s1_read_points_npz", READ)
def s1(spark, d):
    return read_back(S.read_points_npz(stored(spark, d, "npz"), color=False))


@query("s2_read_points_ply", READ)
def s2(spark, d):
    return read_back(S.read_points_ply(stored(spark, d, "ply"), color=False))


@query("s3_read_points", f"{READ} UNION ALL {READ}")
def s3(spark, d):
    return read_back(S.read_points(stored(spark, d, "npz").union(stored(spark, d, "ply")), color=False))


def sweeps(spark, d) -> DataFrame:
    """Cloud L as driving sweeps (path, content): a file for each cloud and 64th of its ids; every second one has labels."""
    rows = cloud_l(spark, d).select("cloud_id", (F.col("point_id") % 64).alias("piece"), "point_id", *[(F.floor(F.col(c) * 64) / 64).alias(c) for c in "xyz"], "label")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        files = []
        for piece, scan in part.sort_values("point_id").groupby("piece", dropna=False):
            name = f"{key[0]}_{piece}"
            files.append((f"velodyne/{name}.bin", scan[["x", "y", "z", "label"]].to_numpy("<f4").tobytes()))
            if piece % 2:
                files.append((f"labels/{name}.label", scan["label"].to_numpy("<u4").tobytes()))
        return pd.DataFrame(files, columns=["path", "content"])

    # eight scans a group: a group costs some 10 ms, whatever it holds
    return rows.groupBy("cloud_id", F.col("piece") % 8).applyInPandas(pack, "path string, content binary")


@query("s4_read_lidar", f"SELECT cloud_id || '_' || piece || '.bin' AS name, row_number() OVER (PARTITION BY cloud_id, piece ORDER BY point_id) - 1 AS point_id, {', '.join(f'floor({c} * 64) / 64 AS {c}' for c in 'xyz')}, label::DOUBLE AS intensity, CASE WHEN piece % 2 = 1 THEN label ELSE 0 END AS label FROM (SELECT *, point_id % 64 AS piece FROM {CLOUD_L})")
def s4(spark, d):
    path = folder(spark)
    S.save_files(sweeps(spark, d), path)
    found = S.read_lidar(spark, path, split=1 << 14)  # small ranges, so that one scan is many tasks here, too
    return found.select(F.substring_index("path", "/", -1).alias("name"), "point_id", "x", "y", "z", "intensity", "label")


@query("s4_read_lidar_tree", f"SELECT split, cloud_id || '_' || piece || '.bin' AS name, count(*) AS n, sum(CASE WHEN piece % 2 = 1 THEN label ELSE 0 END)::BIGINT AS label FROM (SELECT *, point_id % 64 AS piece, CASE cloud_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS part FROM {CLOUD_L}) JOIN (VALUES ('train', 'train'), ('val', 'val'), ('test', 'test'), ('train', 'train_val'), ('val', 'train_val')) AS v(part, split) USING (part) GROUP BY ALL")
def s4b(spark, d):
    """Scans in the folders of their sequences, read by split."""
    path = folder(spark)
    files = sweeps(spark, d)
    cloud = F.regexp_extract("path", r"/([0-9]+)_", 1)
    S.save_files(files.withColumn("path", F.concat(F.lit("sequences/"), cloud, F.lit("/"), "path")), path)
    clouds = [r.cloud_id for r in cloud_l(spark, d).select("cloud_id").distinct().collect()]  # one name a sequence
    found = S.read_lidar_tree(spark, path, {str(c): ("train", "val", "test")[c % 3] for c in clouds})
    return found.groupBy("split", F.substring_index("path", "/", -1).alias("name")).agg(F.count("*").alias("n"), F.sum("label").alias("label"))


@query("s5_read_points_txt", READ.replace("round((x)", "round(round((x)::DOUBLE, 6)"))
def s5(spark, d):
    path = folder(spark)
    S.write_points(cloud_l(spark, d), path, "PNL", form="xyz")
    return read_back(S.read_points_txt(spark, path))


@query("s6_read_mesh", f"SELECT f.fid, {r(*[f'v.{c} AS {c}' for c in 'xyz'])} FROM (SELECT mesh_id, fid % 100 AS fid, v0 FROM {scenes_jobs.FACES}) f JOIN {scenes_jobs.VERTICES} v ON v.mesh_id = f.mesh_id AND v.vid = f.v0")
def s6(spark, d):
    v = scenes_jobs.vertices(spark, d).select("mesh_id", "vid", *"xyz")
    both = v.groupBy("mesh_id").agg(F.sort_array(F.collect_list(F.struct("vid", *"xyz"))).alias("v"))

    def mesh(number: int, rows: list) -> bytes:
        n = len(rows)
        faces = [f"3 {k} {k + 1} {k + 2}" for k in range(n - 2)]
        head = [f"OFF{n} {len(faces)} 0"] if number % 2 else ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property double {c}" for c in "xyz"], f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
        return "\n".join(head + [f"{p['x']!r} {p['y']!r} {p['z']!r}" for p in rows] + faces).encode()

    name = F.concat(F.col("mesh_id").cast("string"), F.when(F.col("mesh_id") % 2 == 1, ".off").otherwise(".ply"))
    path = folder(spark)
    S.save_files(both.select(name.alias("path"), F.udf(mesh, "binary", useArrow=False)("mesh_id", "v").alias("content")), path)
    vertices, faces = S.read_mesh(S.binary_files(spark, path))
    return faces.join(vertices.withColumnRenamed("vid", "v0"), ["path", "v0"]).select("fid", *[rounded(c) for c in "xyz"])


@query("s7_filelist", f"SELECT name, right(category, 1)::INT AS label FROM {scenes_jobs.FILES}")
def s7(spark, d):
    path = folder(spark)
    S.write_filelist(scenes_jobs.files(spark, d).select("name", F.substring("category", -1, 1).alias("label")), path)
    return S.read_filelist(spark, path)


@query("s8_read_segmentation_json", "SELECT user_id, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS segments FROM events GROUP BY user_id")
def s8(spark, d):
    path = folder(spark)
    # a scene's segments in objects of about 4096 events each, so that no scene is one row, and many objects in a file
    events = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    pieces = events.groupBy("user_id").agg(F.ceil(F.count("*") / 4096).alias("pieces"))
    rows = events.join(pieces, "user_id").withColumn("piece", F.pmod(F.xxhash64("event_id"), F.col("pieces")))
    rows = rows.groupBy("user_id", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "k"))), lambda v: v["k"]), ",").alias("k"))
    rows.select(F.concat(F.lit('{"sceneId": "'), F.col("user_id").cast("string"), F.lit('", "segIndices": ['), "k", F.lit("]}"))).write.text(path)
    found = S.read_segments(spark, path, ".txt").withColumn("user_id", F.col("scene").cast("long"))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("segment").alias("segments"))


@query("s9_read_label_table", "SELECT p_partkey AS id, p_name AS raw_category, p_type AS category FROM part")
def s9(spark, d):
    path = folder(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw_category"), F.col("p_type").alias("category")).write.csv(path, sep="\t", header=True)
    return S.read_label_table(spark, path, "id bigint, raw_category string, category string")


@query("s10_write_points", f"SELECT {r('x', 'y', 'z', 'f0', 'f1')}, label, cloud_id FROM {CLOUD_L}")
def s10(spark, d):
    path = folder(spark)
    S.write_points(cloud_l(spark, d), path, "PFLB", channels=2)
    back = spark.read.parquet(path)
    return back.select(*[rounded(c) for c in ("x", "y", "z", "f0", "f1")], "label", "cloud_id")


for _form in ("npz", "ply"):
    query(f"s10_write_points_{_form}", READ)(lambda spark, d, form=_form: s10_files(spark, d, form))


def s10_files(spark, d, form: str) -> DataFrame:
    path = folder(spark)
    S.write_points(cloud_l(spark, d), path, "PNL", form=form)
    return read_back(S.read_points(S.binary_files(spark, path), color=False))


@query("s11_write_clouds", f"SELECT cloud_id, count(*) AS n, {r('sum(x) AS sx')} FROM {CLOUD_L} GROUP BY cloud_id")
def s11(spark, d):
    path = folder(spark)
    S.write_clouds(cloud_l(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("cloud_id").cast("long").alias("cloud_id")).agg(F.count("*").alias("n"), rounded(F.sum("x"), "sx"))


# ---------------------------------------------------------------- hooks and workloads

_scaled = f"(SELECT cloud_id, point_id, {', '.join(f'{c} * 0.9::DOUBLE AS {c}' for c in 'xyz')}, nx, ny, nz FROM {CLOUD_L})"


@query("u1_preprocess_hook", f"SELECT cloud_id, key, count(*) AS npt, {r(*[f'avg(p{c}) AS p{c}' for c in 'xyz'])} FROM {keyed_sql(DEPTH, f'(SELECT * FROM {augmented_sql(_scaled, params_sql())} WHERE {INSIDE})')} GROUP BY cloud_id, key")
def u1(spark, d):
    """preprocess -> augment -> build with a user's own preprocess step."""
    made = workloads.transform(cloud_l(spark, d), lambda p: P.scale(p, (0.9, 0.9, 0.9)), params(spark, d), DEPTH, 2)
    return made.select("cloud_id", "key", "npt", rounded("px"), rounded("py"), rounded("pz"))


@query("u2_read_hook", READ)
def u2(spark, d):
    """A parser registered for a suffix of its own."""
    S.PARSERS["pts"] = S.parsers.npz_points
    try:
        files = stored(spark, d, "npz").withColumn("path", F.regexp_replace("path", "npz$", "pts"))
        return read_back(S.read_points(files, color=False))
    finally:
        del S.PARSERS["pts"]


@query("u3_collate_batch", f"SELECT (SELECT count(DISTINCT cloud_id) FROM {CLIPPED} c WHERE c.cloud_id > n.cloud_id) AS batch_id, k, count(*) AS n, sum(nkey)::BIGINT AS keys FROM {neigh_sql()} n GROUP BY cloud_id, k")
def u3(spark, d):
    points = clipped(spark, d)
    order = ranked(points.select("cloud_id").distinct(), -F.floor(F.col("cloud_id") / 4096), [F.desc("cloud_id")], name="batch_idx")
    nodes, neighbours = workloads.collate(O.voxelize(points, DEPTH), order, DEPTH, FULL)
    there = neighbours.join(nodes.where(F.col("depth") == DEPTH).select(F.col("batch_id").cast("long").alias("cloud_id"), "key"), ["cloud_id", "key"], "left_semi")
    return there.groupBy(F.col("cloud_id").alias("batch_id"), "k").agg(F.count("*").alias("n"), F.sum("nkey").alias("keys"))


@query("workload_score_scenes")
def score(spark, d):
    return workloads.score_scenes(feat(spark, d), clipped(spark, d), DEPTH, 3).select("cloud_id", rounded("iou"), "n_classes")


@query("workload_training_table")
def training(spark, d):
    ids = scenes_jobs.class_ids(spark)
    made = workloads.training_table(cloud_l(spark, d), P.parse_alignment(alignments(spark, d)), ids, 0.9, 0.45, 12)
    return made.select("cloud_id", "chunk_id", "row_in_chunk", "point_id", rounded("x"), "label")
