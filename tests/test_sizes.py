"""Queries on tables with more rows or larger keys than the driver's small ones."""

import io
import json
import re

import duckdb
import numpy as np
import pytest

from voxmill.jobs import catalog
from voxmill.jobs.tables import FITS, ORDERS
from voxmill.operators import augment, lookup
from voxmill.sources import stores

from .test_queries import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_point_ids_of_large_order_keys(spark, tmp_path):
    """Ids are as in the SQL where that has a long for them, and elsewhere unique within their cloud."""
    con = duckdb.connect()
    shifted = f"SELECT * REPLACE (l_orderkey + k AS l_orderkey) FROM '{DATA}/lineitem.parquet', (VALUES (0), (1150000), (9000000)) AS t(k)"
    con.execute(f"COPY ({shifted}) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet' WHERE l_orderkey < 1152921")
    got = catalog.QUERIES["p18_label_filter"](spark, str(tmp_path)).toPandas()
    assert len(got) == con.execute(f"SELECT count(*) FROM '{tmp_path}/lineitem.parquet' WHERE l_returnflag <> 'A'").fetchone()[0]
    want = con.execute(catalog.ORACLES["p18_label_filter"]).df()
    assert len(got.merge(want, on=["cloud_id", "point_id", "label"])) == len(want) > 0
    sums = catalog.QUERIES["p1_validate_points"](spark, str(tmp_path)).first()
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    once = con.execute(catalog.ORACLES["p1_validate_points"]).df().iloc[0]
    assert sums.n_points == 3 * once.n_points and sums.repeated_ids == 3 * once.repeated_ids and sums.n_clouds == 3 * once.n_clouds


#: Queries whose results have point ids of cloud L, or count them.
WITH_IDS = ["e5_restore_clipped", "j10_assign_chunks", "j1_search_key", "j2_search_xyzb", "j6_nearest", "o1_point_to_node", "p12_normalize_box", "p13_preprocess_scene", "p14_preprocess_lidar", "p17_align_axes", "p18_label_filter", "p1_validate_points", "p2_orient_normal_x", "p2_orient_normal_xyz", "p2_orient_normal_z", "a2_augment", "j1_stored_search_key", "j7_linear", "j6_stored_nearest", "j7_linear_wrapping", "j8_interp", "j7_stored_linear"]
#: Cloud L's point id in SQL, and the same with an order key that counts from its cloud's first where the id would be no long.
PLAIN = "l_orderkey * 200000 + l_partkey"
COUNTED = f"CASE WHEN abs({PLAIN}) <= {FITS} THEN {PLAIN} ELSE l_orderkey % {ORDERS} * 200000 + l_partkey END"


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The smallest tables, but with lineitem's orders three times: as they are, around the last key whose ids fit, and far beyond."""
    folder, con = tmp_path_factory.mktemp("large_keys"), duckdb.connect()
    for t in DATA.glob("*.parquet"):
        if t.stem != "lineitem":
            (folder / t.name).symlink_to(t)
    shifted = f"SELECT * REPLACE (l_orderkey + k AS l_orderkey) FROM '{DATA}/lineitem.parquet', (VALUES (0), (1152000), (9000000)) AS t(k)"
    con.execute(f"COPY ({shifted}) TO '{folder}/lineitem.parquet'")
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return str(folder), con


@pytest.mark.parametrize("name", WITH_IDS)
def test_large_order_keys(spark, large_keys, name):
    """Every row is there and equals that of the SQL with ids that stay longs."""
    folder, con = large_keys
    assert PLAIN in catalog.ORACLES[name]
    want = con.execute(catalog.ORACLES[name].replace(PLAIN, COUNTED)).df()
    got = catalog.QUERIES[name](spark, folder).toPandas()
    assert set(got.columns) == set(want.columns) and len(got) == len(want) > 0
    by = [c for c in ("cloud_id", "point_id", "chunk_id") if c in want.columns] or list(want.columns)
    got, want = (df.sort_values(by).reset_index(drop=True) for df in (got, want))
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c], rtol=0, atol=2e-6, equal_nan=True)
        else:
            assert (got[c] == want[c]).all()


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_many_scenes_in_a_file(step):
    want = [(f'scene "{k}\\', list(range(k, k + k % 5))) for k in range(40)]
    text = "\n".join(json.dumps({"params": {"a": [1]}, "sceneId": s, "segIndices": x}) for s, x in want) + '\n{"segIndices": [7]}'
    got = {}
    for scene, at, numbers in stores.segment_arrays(io.BytesIO(text.encode()), step):
        assert at == len(got.setdefault(scene, []))
        got[scene] += numbers.tolist()
    assert got == {s: x for s, x in want if x} | {None: [7]}


def test_small_files_are_many_tasks(tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.json").write_text('{"segIndices": [1]}')
    parts = stores.SegmentReader({"path": str(tmp_path)}).partitions()
    assert sum(len(p.parts) for p in parts) == 600 and max(len(p.parts) for p in parts) <= 256


def test_ranges_grow_where_tasks_would_be_many(tmp_path):
    """Ranges of one record would be 100,900 tasks; whatever their size, every record is read once, in order."""
    scans = {"big.bin": 100_000} | {f"{k}.bin": 3 for k in range(300)}
    points = np.random.default_rng(8).normal(size=(100_000, 4)).astype("<f4")
    for name, n in scans.items():
        points[:n].tofile(tmp_path / name)
    reader = stores.LidarReader({"path": str(tmp_path), "split": "16"})
    parts = reader.partitions()
    assert 2000 < len(parts) < 10_000
    got = {}
    for batch in (b for p in parts for b in reader.read(p)):
        at, x, label = (batch.column(c).to_numpy() for c in ("point_id", "x", "label"))
        name = batch.column("path")[0].as_py().rpartition("/")[2]
        assert at[0] == got.get(name, 0) and (np.diff(at) == 1).all() and (x == points[at, 0]).all() and not label.any()
        got[name] = at[-1] + 1
    assert got == scans


def test_resample_of_many_points(spark, tmp_path):
    """Draws are by ranks in 64 slots, also where the table has more than 65,536 points."""
    con = duckdb.connect()
    grown = f"SELECT * REPLACE (vec_id + k * (SELECT max(vec_id) + 1 FROM '{DATA}/embeddings.parquet') AS vec_id) FROM '{DATA}/embeddings.parquet', range(70000 // (SELECT count(*) FROM '{DATA}/embeddings.parquet') + 1) AS t(k)"
    con.execute(f"COPY ({grown}) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = catalog.QUERIES["a7_resample_with_noise"](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES["a7_resample_with_noise"]).df()
    met = got.merge(want, on=["cloud_id", "draw", "point_id"], suffixes=("", "_sql"))
    assert len(met) == len(got) == len(want) and all((met[c] - met[f"{c}_sql"]).abs().max() < 2e-6 for c in "xyz")


def test_blocks_read_their_features_once(spark):
    """Without nodes, rows and rim come of one pass over the features."""
    plan = catalog.QUERIES["c3_conv_blocks_deep"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1


@pytest.mark.parametrize("name", ["j7_linear", "j7_linear_wrapping", "j8_interp", "j7_stored_linear"])
def test_trilinear_sums_are_compiled(spark, capsys, name):
    """Java leaves methods of over 8000 bytes uncompiled: a point then took some 45 us of CPU."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalog.QUERIES[name](spark, str(DATA)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_null_channels_count_as_zero(spark):
    """As sums in SQL pass over them; the cell's weight still counts."""
    feat = spark.createDataFrame([(1, 0, [None, 2.0]), (1, 1, [3.0, None])], "cloud_id long, key long, data array<double>")
    query = spark.createDataFrame([(1, 7, 0.5, 0.5, 0.75), (1, 8, 2.5, 2.5, 2.5), (1, 9, None, 0.5, 0.5)], "cloud_id long, point_id long, x double, y double, z double")
    got = {r.point_id: r.data for r in lookup.linear(feat, query, 2, 2).collect()}
    assert np.allclose(got[7], [0.75, 1.5]) and got[8] == got[9] == [0.0, 0.0]


def test_augmentation_is_compiled(spark, capsys):
    """As above; without length and sign of a normal worked out for each axis, its method is short enough."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalog.QUERIES["a2_augment"](spark, str(DATA)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("even", [True, False])
def test_augmented_rows(spark, even):
    """Each point by plain numbers: flip, turn, shift, scale, thin normals; null and short normals, columns with names of the helper's own."""
    rows = [(1, 1, 0.1, -0.2, 0.3, 0.6, 0.0, -0.8), (1, 2, 0.4, 0.5, -0.6, None, 0.0, 1.0), (1, 3, 0.9, 0.9, 0.9, 0.0, 0.0, 0.0), (2, 1, -0.3, 0.2, 0.1, 0.0, 1.0, 0.0)]
    points = spark.createDataFrame([(*r, 7.0, 8.0) for r in rows], "cloud_id long, point_id long, x double, y double, z double, nx double, ny double, nz double, length double, dx double")
    sizes = (0.9, 0.9, 0.9) if even else (0.9, 0.8, 1.1)
    given = {1: ((0.2, -0.4, 1.0), sizes, (0.05, 0.0, -0.1), (True, False, True)), 2: ((0.0, 0.3, -2.0), sizes, (0.0, 0.1, 0.0), (False, None, False))}
    params = spark.createDataFrame([(c, *sum(p, ())) for c, p in given.items()], "cloud_id long, ax double, ay double, az double, sx double, sy double, sz double, tx double, ty double, tz double, fx boolean, fy boolean, fz boolean")
    got = {(r.cloud_id, r.point_id): r for r in augment.augment(points, params).collect()}
    want = {}
    for cloud, point, *v in rows:
        angle, size, shift, flip = given[cloud]
        (ca, cb, cc), (sa, sb, sc) = np.cos(angle), np.sin(angle)
        m = np.array([[1, 0, 0], [0, ca, sa], [0, -sa, ca]]) @ [[cb, 0, -sb], [0, 1, 0], [sb, 0, cb]] @ [[cc, sc, 0], [-sc, cc, 0], [0, 0, 1]]
        p, n = (np.array(part, float) * [-1 if f else 1 for f in flip] @ m for part in (v[:3], v[3:]))
        p = (p + shift) * size
        if not even:
            n = n / size
            n = n / max(np.sqrt((n * n).sum()), 1e-12)
        if (abs(p) < 0.99).all():
            want[cloud, point] = [*p, *n]
    assert set(got) == set(want) and len(want) > 2
    for k, w in want.items():
        assert np.allclose([np.nan if got[k][c] is None else got[k][c] for c in ("x", "y", "z", "nx", "ny", "nz")], w, atol=1e-12, equal_nan=True)
        assert got[k]["length"] == 7.0 and got[k]["dx"] == 8.0
