"""The three-point tree, and laws that tie operators together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import keys as K
from voxmill.operators import blocks as B
from voxmill.operators import features as G
from voxmill.operators import lookup as J
from voxmill.operators import octree as O
from voxmill.operators import stencil as C
from voxmill.operators.augment import shell_points
from voxmill.schema import POINTS

ROWS = [(0, 0, -1.0, -1.0, -1.0, 1.0, 0.0, 0.0, [1.0, -1.0], 0), (0, 1, 0.0, 0.0, -1.0, -1.0, 0.0, 0.0, [2.0, -2.0], 2), (0, 2, 0.0625, 0.0625, -1.0, 0.0, 1.0, 0.0, [3.0, -3.0], 2)]


@pytest.fixture(scope="module")
def voxels(spark):
    return O.voxelize(spark.createDataFrame(ROWS, POINTS), 5).cache()


@pytest.fixture(scope="module")
def nodes(voxels):
    return O.build_nodes(voxels, 5, 1).cache()


def test_three_point_tree(nodes):
    expected = {0: ([0], [0]), 1: (range(8), [0, 6]), 2: ([*range(8), *range(48, 56)], [0, 8]), 3: ([*range(8), *range(384, 392)], [0, 8]), 4: ([*range(8), *range(3072, 3080)], [0, 8]), 5: ([*range(8), *range(24576, 24584)], [0, 8, 14])}
    for depth, (keys, full) in expected.items():
        rows = sorted((r.key, r.nempty, r.child) for r in nodes.where(F.col("depth") == depth).collect())
        assert [k for k, _, _ in rows] == list(keys)
        assert [i for i, (_, n, _) in enumerate(rows) if n] == full
        assert [c for _, n, c in rows if n] == list(range(len(full)))
        assert all(c == -1 for _, n, c in rows if not n)


def test_three_point_signal(voxels):
    rows = {r.key: r for r in O.average_signal(voxels, 2).collect()}
    assert sorted(rows) == [0, 24576, 24582]
    assert list(rows[24582].features) == [3.0, -3.0] and (rows[24582].nx, rows[24582].ny) == (0.0, 1.0)


def test_counts_add_up(nodes):
    rows = {(r.depth, r.cloud_id): (r.nnum, r.nnum_nempty) for r in O.node_counts(nodes).collect()}
    assert rows[5, 0] == (16, 3) and rows[None, None] == (73, 12)


def test_split_and_grow_rebuild(nodes):
    flags = nodes.where("depth = 4").select("cloud_id", "key", F.col("nempty").cast("int").alias("split"))
    grown = O.grow(O.split(nodes, flags, 4))
    assert {r.key for r in grown.collect()} == {r.key for r in nodes.where("depth = 5").collect()}


def test_key_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 16, (2000, 3)).tolist()
    df = spark.createDataFrame(rows, "x long, y long, z long")
    key = K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), 16)
    cloud, inner = K.unpack_key(K.pack_key(F.col("x") % 32768, key))
    x, y, z = K.key_to_xyz(inner)
    assert df.where((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z")) | (cloud != F.col("x") % 32768)).count() == 0


@pytest.mark.parametrize(("depth", "cells"), [(5, 3840), (6, 15192), (7, 64160)])
def test_shell(spark, depth, cells):
    assert shell_points(spark, 1 << depth).count() == cells


@pytest.fixture(scope="module")
def cloud(spark):
    """Two random clouds with four channels at depth 4."""
    rng = np.random.default_rng(2)
    rows = [(c, k, *map(float, rng.uniform(-0.9, 0.9, 3)), *map(float, rng.normal(size=3)), list(map(float, rng.normal(size=4))), 0) for c in (0, 1) for k in range(120)]
    voxels = O.voxelize(spark.createDataFrame(rows, POINTS), 4)
    nodes = O.build_nodes(voxels, 4, 2).cache()
    feat = O.average_signal(voxels, 4).select("cloud_id", F.lit(4).alias("depth"), "key", F.col("features").alias("data")).cache()
    return nodes, feat


def table(df):
    return {(r.cloud_id, r.key): np.array(r.data) for r in df.collect()}


def dense(feat):
    out = np.zeros((2, 16, 16, 16, 4))
    full = np.zeros((2, 16, 16, 16), bool)
    for (c, key), v in table(feat).items():
        at = tuple(sum(((key >> (3 * i + s)) & 1) << i for i in range(4)) for s in (2, 1, 0))
        out[(c, *at)], full[(c, *at)] = v, True
    return out, full


def test_conv_forms_agree_with_dense(cloud):
    nodes, feat = cloud
    w = C.example_weights(27, 4, 3)
    joined, blocks = table(C.conv(feat, nodes, 4, w)), table(B.conv_blocks(feat, 4, w))
    grid, _ = dense(feat)
    padded = np.pad(grid, ((0, 0), (1, 1), (1, 1), (1, 1), (0, 0)))
    assert joined.keys() == blocks.keys()
    for (c, key), v in joined.items():
        x, y, z = (sum(((key >> (3 * i + s)) & 1) << i for i in range(4)) for s in (2, 1, 0))
        patch = padded[c, x : x + 3, y : y + 3, z : z + 3].reshape(27, 4)
        np.testing.assert_allclose(v, np.einsum("ki,kio->o", patch, w), atol=1e-9)
        np.testing.assert_allclose(blocks[c, key], v, atol=1e-9)


def test_depthwise_is_one_convolution_a_channel(cloud):
    nodes, feat = cloud
    w = C.example_weights(27, 4)
    whole = table(C.depthwise_conv(feat, nodes, 4, w))
    for ch in range(4):
        one = feat.withColumn("data", F.array(F.col("data")[ch]))
        single = table(C.conv(one, nodes, 4, w[:, ch].reshape(27, 1, 1)))
        for k, v in whole.items():
            np.testing.assert_allclose(v[ch], single[k][0], atol=1e-9)


def test_col_round_trip_counts_neighbours(cloud):
    nodes, feat = cloud
    ones = feat.withColumn("data", F.array(F.lit(1.0)))
    back = table(C.scatter_columns(C.columns(ones, nodes, 4, "333"), nodes, 4, 1, "333"))
    met = {(r.cloud_id, r.nkey): r["count"] for r in O.neighbors(nodes, 4, "333", 1, True).groupBy("cloud_id", "nkey").count().collect()}
    assert {k: v[0] for k, v in back.items()} == met


def test_norms_have_mean_zero_and_variance_one(cloud):
    _, feat = cloud
    for fn, channels in ((G.instance_norm, 4),):
        out = table(fn(feat, channels, [1.0] * 4, [0.0] * 4))
        for c in (0, 1):
            v = np.stack([x for (cloud_id, _), x in out.items() if cloud_id == c])
            np.testing.assert_allclose(v.mean(0), 0, atol=1e-5)
            np.testing.assert_allclose(v.var(0), 1, atol=1e-3)


def test_group_norm_against_dense(cloud):
    _, feat = cloud
    out, src = table(G.group_norm(feat, 4, 2, [1.0] * 4, [0.0] * 4, least=2)), table(feat)
    for c in (0, 1):
        keys = [k for k in src if k[0] == c]
        v = np.stack([src[k] for k in keys]).reshape(len(keys), 2, 2)
        want = (v - v.mean((0, 2), keepdims=True)) / np.sqrt(v.var((0, 2), keepdims=True) + 1e-5)
        np.testing.assert_allclose(np.stack([out[k] for k in keys]), want.reshape(len(keys), 4), atol=1e-5)


def test_unpool_undoes_pool(cloud):
    nodes, feat = cloud
    pooled = G.max_pool(feat, 4, 4)
    back = table(G.max_unpool(pooled, 3, 4, nodes))
    src = table(feat)
    for k, v in back.items():
        hit = v != 0
        np.testing.assert_allclose(v[hit], src[k][hit])


def test_nearest_upsample_is_lookup_at_child_centres(cloud):
    nodes, feat = cloud
    coarse = G.max_pool(feat, 4, 4).select("cloud_id", "depth", "key", "data").cache()
    a = table(G.nearest_upsample(coarse, 3, nodes))
    b = table(G.upsample(coarse, nodes, 3, 4, 4, "nearest"))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_linear_at_cell_centre_is_the_cell(cloud, spark):
    nodes, feat = cloud
    query = O.to_points(feat.withColumns({c: F.lit(None).cast("double") for c in ("px", "py", "pz")}), 4, rescale=False).select("cloud_id", F.col("key").alias("point_id"), "x", "y", "z")
    found = {(r.cloud_id, r.point_id): r.data for r in J.linear(feat, query, 4, 4).collect()}
    for k, v in table(feat).items():
        np.testing.assert_allclose(found[k], v, atol=1e-9)


def test_child_index_in_small_blocks(nodes):
    a = O.child_index(nodes.drop("child"), block=1)
    assert {(r.depth, r.key, r.child) for r in a.collect()} == {(r.depth, r.key, r.child) for r in nodes.collect()}


def test_empty_cloud(spark):
    empty = O.voxelize(spark.createDataFrame([], POINTS), 4)
    assert O.build_nodes(empty, 4, 2).count() == 0 and O.average_signal(empty, 2).count() == 0


@pytest.mark.parametrize("kernel, stride, nempty, height", [("333", 1, True, 1), ("333", 2, True, 3), ("222", 2, False, 1), ("311", 1, False, 3)])
def test_block_forms_agree_with_the_join_form(cloud, kernel, stride, nempty, height):
    nodes, feat = cloud
    size = len(O.kernel_offsets(kernel))
    w, deep = C.example_weights(size, 4, 3), C.example_weights(size, 4)
    groups = [C.example_weights(size, 1, 2), C.example_weights(size, 3, 1)]
    upper = G.avg_pool(feat, nodes, 4, 4).select("cloud_id", "depth", "key", "data")
    back = (upper, 3) if stride == 2 else (feat, 4)
    pairs = [
        (C.conv(feat, nodes, 4, w, [1.0, 2.0, 3.0], kernel, stride, nempty), B.conv_blocks(feat, 4, w, kernel, height, nodes, [1.0, 2.0, 3.0], stride, nempty)),
        (C.deconv(back[0], nodes, back[1], C.example_weights(size, 2, 4), kernel, stride, nempty), B.deconv_blocks(back[0], nodes, back[1], C.example_weights(size, 2, 4), kernel, height, stride, nempty)),
        (C.depthwise_conv(feat, nodes, 4, deep, kernel, stride, nempty), B.depthwise_blocks(feat, nodes, 4, deep, kernel, height, stride, nempty)),
        (C.group_conv(feat, nodes, 4, groups, kernel, stride, nempty), B.group_blocks(feat, nodes, 4, groups, kernel, height, stride, nempty)),
    ]
    for joined, blocks in pairs:
        want, got = table(joined), table(blocks)
        assert want.keys() == got.keys() and all(np.allclose(got[k], v, atol=1e-9) for k, v in want.items())


def test_single_nodes_at_block_borders(spark):
    """Nodes at corners, edges, faces and inside of blocks: each other block that they reach has rim only."""
    spots = [(7, 7, 7), (8, 7, 7), (7, 0, 3), (3, 3, 3), (15, 15, 15), (0, 0, 0)]
    rows = spark.createDataFrame([(c, *xyz, [1.0 + c]) for c, xyz in enumerate(spots)], "cloud_id long, x long, y long, z long, data array<double>")
    feat = rows.select("cloud_id", F.lit(4).alias("depth"), K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), 4).alias("key"), "data")
    w = C.example_weights(27, 1, 1)
    for height in (1, 2, 3, 4):
        got = table(B.conv_blocks(feat, 4, w, height=height))
        assert {c: v[0] for (c, _), v in got.items()} == {c: (1.0 + c) * w[13, 0, 0] for c in range(len(spots))}
    assert B.conv_blocks(feat.limit(0), 4, w).count() == 0


def test_deep_shell_by_blocks(spark):
    """At depth 9 each node of a shell has its neighbours counted, in the join form and by blocks."""
    points = shell_points(spark, 512).where("x < 40 and y < 300")
    feat = points.select(F.lit(0).cast("long").alias("cloud_id"), F.lit(9).alias("depth"), K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), 9).alias("key"), F.array(F.lit(1.0)).alias("data"))
    nodes = feat.select("cloud_id", "depth", "key", F.lit(True).alias("nempty"))
    ones = np.ones((27, 1, 1))
    both = B.conv_blocks(feat, 9, ones).alias("b").join(C.conv(feat, nodes, 9, ones).alias("j"), ["cloud_id", "key"], "full")
    assert both.where("b.data is null or j.data is null or b.data[0] != j.data[0]").count() == 0 and both.count() > 1000
