"""Transforms of two points, batches, boxes, files."""

from math import pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import classes
from voxmill.functions.clouds import meet
from voxmill.functions.ranks import ranked, running_sum
from voxmill.operators import features as G
from voxmill.operators import points as P
from voxmill.operators import scenes, splits
from voxmill.operators.mesh import vertex_normals
from voxmill.schema import POINTS, validate_points
from voxmill.sources import files as S
from voxmill.sources import stores

A, B = 1 / sqrt(2), 1 / sqrt(3)


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, A, -A, 0.0, [1.0] * 4, 1), (0, 1, -4.0, -5.0, -6.0, -B, -B, B, [2.0] * 4, 2)], POINTS)


def xyz(df, cols=("x", "y", "z")):
    return np.array([[r[c] for c in cols] for r in df.orderBy("point_id").collect()])


def test_orient_normal(two):
    n = xyz(P.orient_normal(two, "x"), ("nx", "ny", "nz"))
    np.testing.assert_allclose(n, [[A, -A, 0], [B, B, -B]])


def test_scale(two):
    np.testing.assert_allclose(xyz(P.scale(two, (0.5, 0.5, 0.5))), xyz(two) / 2)
    n = xyz(P.scale(two, (1.0, 2.0, 3.0)), ("nx", "ny", "nz"))
    want = xyz(two, ("nx", "ny", "nz")) / np.array([1, 2, 3])
    np.testing.assert_allclose(n, want / np.linalg.norm(want, axis=1, keepdims=True))
    with pytest.raises(ValueError):
        P.scale(two, (0.0, 1.0, 1.0))


@pytest.mark.parametrize(("angle", "order"), [((pi / 2, 0, 0), lambda p: (p[0], -p[2], p[1])), ((0, pi / 2, 0), lambda p: (p[2], p[1], -p[0])), ((0, 0, pi / 2), lambda p: (-p[1], p[0], p[2]))])
def test_rotate(two, angle, order):
    for cols in (("x", "y", "z"), ("nx", "ny", "nz")):
        np.testing.assert_allclose(xyz(P.rotate(two, angle), cols), [order(p) for p in xyz(two, cols)], atol=1e-12)


def test_centralize_and_clip(two):
    assert np.abs(xyz(P.centralize_scale(two))).max() <= 1
    assert [r.label for r in P.clip(two, -4.0, 4.0).collect()] == [1]


def test_split_counts(spark):
    df = spark.createDataFrame([(b,) for b in (0, 0, 1, 1, 1, 2, 2)], "batch_id long")
    assert [r.n_points for r in P.split_counts(df, 5).orderBy("batch_id").collect()] == [2, 3, 2, 0, 0]


def test_scatter_add(spark):
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, a, b in zip([0, 1, 3, 2, 0], range(1, 6), range(6, 11))], "index long, data array<double>")
    assert [list(r.data) for r in G.scatter_add(df, 5, 2).orderBy("index").collect()] == [[6, 16], [2, 7], [4, 9], [3, 8], [0, 0]]


def test_missing_normals_stay_null(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, None, None, None, None, 3), (0, 1, 0.5, -0.5, 0.25, None, None, None, None, 3)], POINTS)
    out = P.rotate(P.orient_normal(df, "x"), (0.1, 0.2, 0.3)).collect()
    assert all(r.nx is None and r.label == 3 for r in out)
    assert validate_points(df).first().no_xyz == 0


def test_chunks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.round(rng.uniform(0, 3, (400, 3)) * 64) / 64
    df = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(pts)], "cloud_id long, point_id long, x double, y double, z double")
    got = {(r.point_id, r.chunk_id) for r in scenes.assign_chunks(df, 1.5, 0.75, 20).collect()}
    low, high = pts.min(0), pts.max(0)
    n = (np.ceil(np.maximum(high - 1.5, 0) / 0.75) + 1).astype(int)
    want, chunk = set(), 0
    for i in range(n[0]):
        for j in range(n[1]):
            for k in range(n[2]):
                a = low + np.array([i, j, k]) * 0.75
                inside = np.flatnonzero(((pts >= a) & (pts <= a + 1.5)).all(1))
                if len(inside) >= 20:
                    want |= {(int(p), chunk) for p in inside}
                    chunk += 1
    assert got == want


def test_vertex_normals_of_a_corner(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 5.0, 5.0, 5.0)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    n = {r.vid: (r.nx, r.ny, r.nz) for r in vertex_normals(v, f).collect()}
    assert n[0] == pytest.approx((0, 0, 1), abs=1e-6) and n[3] == (0, 0, 0)


def test_ratio_split_keeps_the_ceiling(spark):
    df = spark.createDataFrame([("a", "train", f"{k:03}") for k in range(7)], "category string, split string, name string")
    rows = splits.ratio_split(df, [0.01, 0.5, 1.0]).groupBy("ratio").count().collect()
    assert {r.ratio: r["count"] for r in rows} == {0.01: 1, 0.5: 4, 1.0: 7}


def test_binary_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(5, 3))
    (tmp_path / "velodyne").mkdir()
    (tmp_path / "labels").mkdir()
    np.savez(tmp_path / "a.npz", points=pts, labels=np.arange(5))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1 2 3 255\n4 5 6 0\n")
    pts.astype("<f4")[:, [0, 1, 2, 0]].tofile(tmp_path / "velodyne" / "0.bin")
    np.arange(5, dtype="<u4").tofile(tmp_path / "labels" / "0.label")
    pts.astype("<f4")[:, [0, 1, 2, 0]].tofile(tmp_path / "velodyne" / "1.bin")
    files = S.binary_files(spark, str(tmp_path))
    rows = S.read_points(files).collect()
    assert len(rows) == 7 and sorted(r.label for r in rows if r.label is not None) == [0, 1, 2, 3, 4]
    assert sorted(r.r for r in rows if r.path.endswith("ply")) == [0.0, 255.0]
    assert S.point_files(spark, str(tmp_path)).count() == 2 and len(S.read_points(S.point_files(spark, str(tmp_path))).collect()) == 7
    lidar = S.read_lidar(spark, str(tmp_path)).collect()
    assert sorted(r.label for r in lidar if r.path.endswith("0.bin")) == [0, 1, 2, 3, 4] and all(r.label == 0 for r in lidar if r.path.endswith("1.bin"))


def test_meshes(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    body = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0)], "<f4").tobytes() + b"\x03" + np.array([0, 1, 2], "<i4").tobytes()
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n" + body)
    v, f = S.read_mesh(S.binary_files(spark, str(tmp_path)))
    assert v.count() == 6 and {(r.v0, r.v1, r.v2) for r in f.collect()} == {(0, 1, 2)} and f.count() == 2


def test_polygons_become_triangles(spark, tmp_path):
    corners = "0 0 0\n1 0 0\n1 1 0\n0 1 0\n0.5 2 0\n"
    (tmp_path / "a.off").write_text(f"OFF\n5 3 0\n{corners}4 0 1 2 3\n5 0 1 2 4 3\n2 0 1\n")
    (tmp_path / "b.ply").write_bytes(f"ply\r\nformat ascii 1.0\r\nelement vertex 5\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nelement face 2\r\nproperty uchar flag\r\nproperty list uchar int vertex_indices\r\nend_header\r\n{corners}7 4 0 1 2 3\n7 3 2 4 3\n".encode())
    body = np.arange(24, dtype="<f4").tobytes() + b"".join(bytes([n]) + np.arange(n, dtype="<i4").tobytes() for n in (3, 4))
    (tmp_path / "c.ply").write_bytes(b"ply\r\nformat binary_little_endian 1.0\r\nelement vertex 8\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nelement face 2\r\nproperty list uchar int vertex_indices\r\nend_header\r\n" + body)
    v, f = S.read_mesh(S.binary_files(spark, str(tmp_path)))
    found = {}
    for r in f.orderBy("fid").collect():
        found.setdefault(r.path[-5:], []).append((r.v0, r.v1, r.v2))
    assert found == {"a.off": [(0, 1, 2), (0, 2, 3), (0, 1, 2), (0, 2, 4), (0, 4, 3)], "b.ply": [(0, 1, 2), (0, 2, 3), (2, 4, 3)], "c.ply": [(0, 1, 2), (0, 1, 2), (0, 2, 3)]}
    assert v.count() == 18


@pytest.mark.parametrize("form", ["npz", "ply"])
def test_points_written_and_read_again(spark, tmp_path, form):
    rows = [(k % 2, k, k * 0.1, -k * 0.2, k * 0.3, 0.0, 1.0, 0.0, [k * 1.0, 2.0], k % 3) for k in range(20)]
    df = spark.createDataFrame(rows, POINTS)
    S.save_files(S.packed_clouds(df, form, "PNFL", 2, rows=4), f"file:{tmp_path}")
    assert len(list(tmp_path.rglob(f"*.{form}"))) > 2 and not list(tmp_path.rglob("_temporary*"))
    back = S.read_points(S.binary_files(spark, str(tmp_path)), color=False).collect()
    assert sorted((r.x, r.y, r.z, r.nx, r.ny, r.nz, r.label) for r in back) == sorted((r[2], r[3], r[4], *r[5:8], r[9]) for r in rows)
    with pytest.raises(Exception, match="nowhere"):
        S.save_files(S.packed_clouds(df, form), "nowhere:/folder")


def test_lidar_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(6)
    scans = {("08", "000000"): 5000, ("08", "000001"): 3, ("09", "000000"): 700, ("10", "000000"): 0}
    want = {}
    for (sequence, frame), n in scans.items():
        for side in ("velodyne", "labels"):
            (tmp_path / "sequences" / sequence / side).mkdir(parents=True, exist_ok=True)
        points, codes = rng.normal(size=(n, 4)).astype("<f4"), rng.integers(0, 1 << 32, n, dtype=np.uint32)
        points.tofile(tmp_path / "sequences" / sequence / "velodyne" / f"{frame}.bin")
        if sequence == "08":  # one label file is too short
            codes[: n - (frame == "000001")].astype("<u4").tofile(tmp_path / "sequences" / sequence / "labels" / f"{frame}.label")
        want |= {(sequence, frame, k): (*map(float, points[k]), int(codes[k]) if sequence == "08" and (frame == "000000" or k < 2) else 0) for k in range(n)}
    df = S.read_lidar(spark, str(tmp_path), split=16 * 512)
    assert df.rdd.getNumPartitions() >= 11 and "Exchange" not in df._jdf.queryExecution().toString()
    got = {(r.sequence, r.path[-10:-4], r.point_id): (r.x, r.y, r.z, r.intensity, r.label) for r in df.collect()}
    assert got == want
    tree = S.read_lidar_tree(spark, f"file:{tmp_path}", {"08": "train", "09": "test"})
    assert {tuple(r) for r in tree.groupBy("sequence", "split").count().collect()} == {("08", "train", 5003), ("08", "train_val", 5003), ("09", "test", 700)}
    (tmp_path / "sequences" / "08" / "velodyne" / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole records"):
        S.read_lidar(spark, str(tmp_path)).count()


def test_failed_job_leaves_no_files(spark, tmp_path):
    files = spark.range(40, numPartitions=4).select(F.format_string("a/%d.bin", "id").alias("path"), F.expr("cast(raise_error('stop') as binary)").alias("content"))
    some = spark.range(40, numPartitions=4).select(F.format_string("a/%d.bin", "id").alias("path"), F.when(F.col("id") < 39, F.encode(F.col("id").cast("string"), "utf-8")).otherwise(F.expr("cast(raise_error('stop') as binary)")).alias("content"))
    for failing in (files, some):
        with pytest.raises(Exception, match="stop"):
            S.save_files(failing, str(tmp_path))
        assert not [p for p in tmp_path.rglob("*") if "_temporary-" not in str(p)]  # a task that is still running may come after the clearing
    S.save_files(some.where("id < 39"), str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.rglob("*.bin")} == {f"{k}.bin": str(k) for k in range(39)}


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_segments_as_a_stream(step):
    import io

    numbers = list(range(1000, 1400))
    for text, want in ((f'{{"a": [1, 2], "segIndices" :\n [{", ".join(map(str, numbers))}], "b": [3]}}', numbers), ('{"segIndices": []}', []), ('{"other": [1]}', []), ('{"segIndices":[5]}', [5])):
        assert [int(x) for part in stores.segment_numbers(io.BytesIO(text.encode()), step) for x in part] == want
    with pytest.raises(ValueError):
        list(stores.segment_numbers(io.BytesIO(b'{"segIndices": [1, 2'), step))


def test_equal_faces_are_read_at_once():
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty uchar flag\nproperty list uchar int vertex_indices\nend_header\n" + np.arange(12, dtype="<f4").tobytes()
    for corners, want in (([[0, 1, 2], [1, 2, 3]], [[0, 1, 2], [1, 2, 3]]), ([[0, 1, 2, 3], [3, 2, 1, 0]], [[0, 1, 2], [0, 2, 3], [3, 2, 1], [3, 1, 0]]), ([[0, 1], [2, 3]], []), ([[0, 1, 2], [3]], [[0, 1, 2]])):
        body = b"".join(bytes([9, len(c)]) + np.array(c, "<i4").tobytes() for c in corners)
        assert stores_mesh(head + body).tolist() == want


def test_obj_meshes(spark, tmp_path):
    """Corners with texture and normal numbers, counted back, continued lines, polygons, comments, and a file without faces."""
    (tmp_path / "a.OBJ").write_text("# a\nv 0 0 0 1\nv 1 0 0\nv 1 1 0.5\nvn 0 0 1\nv 0 1 0\nf 1/1/1 2//1 3/2 \\\n4\nf -1 -2 -3\n")
    (tmp_path / "b.obj").write_text("v 0 0 0\n")
    (tmp_path / "c.off").write_text("OFF3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    v, f = S.read_mesh(S.binary_files(spark, str(tmp_path)))
    name = lambda r: r.path.rpartition("/")[2]
    assert sorted((name(r), r.vid, r.x, r.y, r.z) for r in v.collect() if name(r) == "a.OBJ") == [("a.OBJ", 0, 0, 0, 0), ("a.OBJ", 1, 1, 0, 0), ("a.OBJ", 2, 1, 1, 0.5), ("a.OBJ", 3, 0, 1, 0)]
    assert sorted((name(r), r.fid, r.v0, r.v1, r.v2) for r in f.collect()) == [("a.OBJ", 0, 0, 1, 2), ("a.OBJ", 1, 0, 2, 3), ("a.OBJ", 2, 3, 2, 1), ("c.off", 0, 0, 1, 2)]
    assert v.count() == 8


def stores_mesh(data):
    return S.parsers.ply_mesh(data)[1]


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(2)
    values = [(int(g), int(v), int(x)) for g, v, x in zip(rng.integers(0, 3, 300), rng.permutation(300), rng.integers(-5, 5, 300))]
    df = spark.createDataFrame(values + [(None, 1000, 4)], "g long, v long, x long")
    block = F.floor(F.col("v") / 16)
    got = {(r.g, r.v): r["rank"] for r in ranked(df, block, [F.col("v")], ["g"]).collect()}
    by = {}
    for g, v, x in sorted(values, key=lambda r: r[1]) + [(None, 1000, 4)]:
        by.setdefault(g, []).append((v, x))
    assert got == {(g, v): k for g, rows in by.items() for k, (v, _) in enumerate(rows)}
    assert sorted(r["rank"] for r in ranked(df, block, [F.col("v")]).collect()) == list(range(301))
    sums = running_sum(df, "x", block, [F.col("v")], ["g"], exclusive=True).collect()
    assert {(r.g, r.v): r.total for r in sums} == {k: s for g, rows in by.items() for k, s in [*(((g, v), sum(x for _, x in rows[:n])) for n, (v, _) in enumerate(rows)), ((g, None), sum(x for _, x in rows))]}


def test_category_lists_by_equal_parts(spark):
    lines = spark.createDataFrame([("train", 0, "data/a/x"), ("val", 1, "data/ab/y"), ("test", 2, "data/a/a/z"), ("test", 3, "data/c/a")], "list string, position long, line string")
    got = splits.category_filelists(lines, spark.createDataFrame([("a", 4), ("ab", 5)], "category string, category_id int")).collect()
    assert {(r.list, r.position, r.line) for r in got} == {("train_val", 0, "a/x 4"), ("train_val", 1, "ab/y 5"), ("test", 2, "a/a/z 4"), ("test", 3, "a 4")}


def test_ranks_leave_columns_of_any_name(spark):
    names = ("piece", "n", "at", "start", "within", "rank", "by_g")
    df = spark.createDataFrame([(k, k % 2) for k in range(20)], "position long, g long").select("position", F.col("position").alias("cloud_id"), "g", *[F.lit(f"my {n}").alias(n) for n in names])
    for made in (splits.take(df, 20, 0.5), splits.assign_batches(df, 4), splits.assign_batches(df, 4, seed=3)):
        assert made.columns[: len(df.columns)] == df.columns and all(r[n] == f"my {n}" for r in made.collect() for n in names)
    assert ranked(df, F.lit(0), [F.col("position")], ["g"], name="place").where("place != position div 2").count() == 0


def test_points_meet_their_cloud(spark):
    """Broadcast up to a number of clouds; beyond it by parts, so that one cloud is many tasks. Both give the same."""
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(int(c), k, *map(float, xyz)) for k, (c, xyz) in enumerate(zip(rng.integers(0, 5, 500) // 3, rng.normal(size=(500, 3))))], "cloud_id long, point_id long, x double, y double, z double").withColumn("part", F.lit("mine"))
    boxes = P.bbox(points)
    few, many, plain = meet(points, boxes), meet(points, boxes, most=0), points.join(boxes, "cloud_id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "hashpartitioning" not in plan(few)
    assert "SortMergeJoin" in plan(many) and "Exchange hashpartitioning(cloud_id" in plan(many)
    rows = lambda df: sorted(map(tuple, df.select(*plain.columns).collect()))
    assert rows(few) == rows(many) == rows(plain)
    lone = spark.createDataFrame([(7, [1.0] * 16)], "cloud_id long, m array<double>")
    assert rows(meet(points, lone, how="left", most=0).select(*plain.columns[:6], *[F.lit(0).alias(c) for c in plain.columns[6:]])) == rows(points.select("*", *[F.lit(0).alias(c) for c in plain.columns[6:]]))


def test_categories_by_folder(spark):
    files = spark.createDataFrame([("points/02691156/a.ply",), ("points/04379243/b.ply",), ("points/unknown/c.ply",), ("03001627/02691156/d.ply",)], "path string")
    got = {r.path[-5]: r.category for r in splits.with_category(files, classes.part_folders(spark)).collect()}
    assert got == {"a": "Aero", "b": "Table", "d": "Chair"} and set(classes.FOLDERS) == set(classes.PARTS)
