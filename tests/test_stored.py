"""Stored trees: the results of the plain operators, and plans that leave the tree where it is."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import features as G
from voxmill.operators import lookup as J
from voxmill.operators import octree as O
from voxmill.operators import stored as T
from voxmill.schema import POINTS


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows = [(c, k, *map(float, rng.uniform(-0.95, 0.95, 3)), 0.0, 0.0, 1.0, list(map(float, rng.normal(size=2))), 0) for c in (0, 1, 2) for k in range(300)]
    voxels = O.voxelize(spark.createDataFrame(rows, POINTS), 5)
    nodes = O.build_nodes(voxels, 5, 2).cache()
    feat = O.average_signal(voxels, 2).select("cloud_id", F.lit(5).alias("depth"), "key", F.col("features").alias("data")).cache()
    upper = G.max_pool(feat, 5, 2).select("cloud_id", "depth", "key", "data").cache()
    tree = T.store_tree(nodes, {5: feat, 4: upper}, 2, prefix=3, buckets=6, cells=(5,))
    points = spark.createDataFrame([(int(c), k, *map(float, xyz)) for k, (c, xyz) in enumerate(zip(rng.integers(0, 4, 400), rng.uniform(-2, 34, (400, 3))))], "cloud_id long, point_id long, x double, y double, z double").cache()
    yield tree, nodes, feat, upper, points
    tree.drop()


def shuffles(df):
    """How rows are shuffled in the plan, one string for each exchange."""
    return re.findall(r"Exchange (\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


def rows(df):
    return sorted((tuple(tuple(np.round(x, 9)) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def test_look_ups(made):
    tree, nodes, feat, upper, points = made
    asked = points.select("cloud_id", "point_id", F.floor(F.col("x") * 900 % 32768).cast("long").alias("key"))
    for got, want in (
        (T.search_key(tree, asked, 5), J.search_key(asked, nodes, 5, nempty=True)),
        (T.align(tree, asked, 5), J.align(feat, asked, 2)),
        (T.nearest(tree, points, 5), J.nearest(feat, points, 5, 2)),
        (T.linear(tree, points, 5), J.linear(feat, points, 5, 2)),
        (T.search_xyz(tree, points, 5), J.search_xyz(points, nodes, 5, nempty=True)),
        (T.interpolate(tree, points, 5, low=0.0, high=32.0), J.interpolate(feat, points, 5, 2, low=0.0, high=32.0)),
    ):
        got, want = got.select(*sorted(want.columns)), want.select(*sorted(want.columns))
        moved = shuffles(got)
        assert len(moved) == 1 and ", 6" in moved[0]  # the queries, to as many parts as there are buckets
        assert rows(got) == rows(want)


@pytest.mark.parametrize("kernel, nempty", [("333", False), ("222", True)])
def test_neighbours_cross_blocks_only_where_they_must(made, kernel, nempty):
    tree, nodes, *_ = made
    got = T.neighbors(tree, 5, kernel, nempty)
    assert len(shuffles(got)) == 1 and "nblock" in shuffles(got)[0]
    assert rows(got.select("cloud_id", "key", "k", "nkey")) == rows(O.neighbors(nodes, 5, kernel, 1, nempty).select("cloud_id", "key", "k", "nkey"))


def test_pooling_and_upsampling_without_a_shuffle(made):
    tree, nodes, feat, upper, _ = made
    for got, want in (
        (T.max_pool(tree, 5).select("cloud_id", "key", "data"), G.max_pool(feat, 5, 2).select("cloud_id", "key", "data")),
        (T.avg_pool(tree, 5).select("cloud_id", "key", "data"), G.avg_pool(feat, nodes, 5, 2).select("cloud_id", "key", "data")),
        (T.max_unpool(tree, 5).select("cloud_id", "key", "data"), G.max_unpool(G.max_pool(feat, 5, 2), 4, 2, nodes).select("cloud_id", "key", "data")),
        (T.nearest_upsample(tree, 4).select("cloud_id", "key", "data"), G.nearest_upsample(upper, 4, nodes).select("cloud_id", "key", "data")),
    ):
        assert shuffles(got) == [] and rows(got) == rows(want)


def test_levels_above_the_blocks_are_refused(made):
    _, nodes, feat, *_ = made
    with pytest.raises(ValueError):
        T.store_tree(nodes, {2: feat}, 2, prefix=3)


def test_features_of_stored_cells_are_worked_out_once(spark, made):
    """The level and its cells are two tables of the same features."""
    _, nodes, feat, _, _ = made
    seen = spark.sparkContext.accumulator(0)

    def tally(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    tree = T.store_tree(nodes, {5: feat.mapInPandas(tally, feat.schema)}, 2, prefix=3, buckets=6, cells=(5,))
    tree.drop()
    assert seen.value == feat.count()
