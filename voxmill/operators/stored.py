"""Octrees that are stored once and asked often.

Each level from the depth ``prefix`` down is a table of its own, in buckets of (cloud, block), where a node's block is its
ancestor at that depth. So all that is below a block, at every level, lies in buckets of the same number: joins of parents and children, and
sums over siblings, need no shuffle at all. Look-ups deal their queries to the buckets; the tree stays where it is. Neighbours within a
block, most of them, are met without any shuffle, and only the questions that cross a block's border are dealt. For trilinear
look-ups the cells around each place are stored side by side, too.

Spark's planner must be allowed to join on more keys than rows are dealt by; ``store_tree`` tells the session so (BY_BUCKET).

The number of buckets is that of the tasks that read a tree: one for some hundred thousand nodes. Tables are external ones below
a folder that all executors share; ``drop`` takes them out of the catalog.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.keys import parent, xyz_to_key, zeros
from voxmill.operators import features, lookup
from voxmill.operators.octree import kernel_keys
from voxmill.staging import folder, kept


#: With this setting rows dealt by (cloud, block) need not be dealt again for a join on (cloud, block, key).
BY_BUCKET = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


@dataclass(frozen=True)
class StoredTree:
    """``tables`` has the name of each level's table (cloud_id, block, key, nempty, child, data), ``cells`` those of cells around places."""

    spark: SparkSession
    prefix: int
    buckets: int
    channels: int
    tables: dict[int, str]
    cells: dict[int, str]

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.tables[depth])

    def feat(self, depth: int) -> DataFrame:
        return self.level(depth).where("data is not null")

    def dealt(self, rows: DataFrame, block: str = "block") -> DataFrame:
        """Rows (cloud_id, block, ...) dealt as the buckets are."""
        return rows.repartition(self.buckets, "cloud_id", block)

    def drop(self) -> None:
        for name in [*self.tables.values(), *self.cells.values()]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _saved(rows: DataFrame, buckets: int, key: str) -> str:
    """The name of a new bucketed table of rows (cloud_id, block, ``key``, ...): one sorted file a bucket."""
    name = f"voxmill_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "cloud_id", "block")
    dealt.write.bucketBy(buckets, "cloud_id", "block").sortBy("cloud_id", "block", key).option("path", folder(rows.sparkSession)).saveAsTable(name)
    return name


def store_tree(nodes: DataFrame, feats: dict[int, DataFrame], channels: int, prefix: int, buckets: int = 64, cells: tuple[int, ...] = ()) -> StoredTree:
    """Store the levels of ``feats`` (cloud_id, key, data by depth), with their ``nodes`` (cloud_id, depth, key, nempty, child).

    ``cells`` names the depths for which trilinear look-ups (with bounds) are wanted.
    """
    nodes.sparkSession.conf.set(*BY_BUCKET)
    tables, around = {}, {}
    for depth, feat in feats.items():
        if depth < prefix:
            raise ValueError(f"level {depth} is above the blocks, which are nodes of depth {prefix}")
        if depth in cells:
            feat = kept(feat.select("cloud_id", "key", "data"))  # both tables read it
        level = nodes.where(F.col("depth") == depth).select(F.col("cloud_id").cast("long").alias("cloud_id"), "key", "nempty", "child")
        level = level.join(feat.select("cloud_id", "key", "data"), ["cloud_id", "key"], "left")
        tables[depth] = _saved(level.withColumn("block", parent(F.col("key"), depth - prefix)), buckets, "key")
        if depth in cells:
            places = lookup.cells_around(feat.withColumn("cloud_id", F.col("cloud_id").cast("long")), depth)
            around[depth] = _saved(places.withColumn("block", parent(F.col("place"), depth - prefix)), buckets, "place")
    return StoredTree(nodes.sparkSession, prefix, buckets, channels, tables, around)


def _blocked(tree: StoredTree, rows: DataFrame, depth: int, key: str = "key") -> DataFrame:
    """Rows with a block by their key, dealt as the buckets are; rows without a key are spread over blocks that no node has."""
    nowhere = -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(8 * tree.buckets))
    moved = rows.withColumn("cloud_id", F.col("cloud_id").cast("long")).withColumn("block", F.coalesce(parent(F.col(key), depth - tree.prefix), nowhere))
    return tree.dealt(moved)


def search_key(tree: StoredTree, query: DataFrame, depth: int) -> DataFrame:
    """``query`` (with cloud_id, key) plus ``idx``: the row position among the non-empty nodes of ``depth``, or -1."""
    at = tree.level(depth).where("nempty").select("cloud_id", "block", "key", F.col("child").alias("idx"))
    return _blocked(tree, query, depth).join(at.hint("merge"), ["cloud_id", "block", "key"], "left").withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long"))).drop("block")


def search_xyz(tree: StoredTree, query: DataFrame, depth: int) -> DataFrame:
    """As ``search_key`` for coordinates x, y, z scaled to [0, 2 ** depth)."""
    return search_key(tree, query.withColumn("key", xyz_to_key(F.col("x"), F.col("y"), F.col("z"), depth)), depth)


def align(tree: StoredTree, query: DataFrame, depth: int) -> DataFrame:
    """``query`` (cloud_id, key) plus ``data`` at the same key, zeros where there is none."""
    held = tree.level(depth).select("cloud_id", "block", "key", "data")
    return _blocked(tree, query, depth).join(held.hint("merge"), ["cloud_id", "block", "key"], "left").withColumn("data", F.coalesce("data", zeros(tree.channels))).drop("block")


def nearest(tree: StoredTree, query: DataFrame, depth: int) -> DataFrame:
    """Feature of the cell that holds each query point (cloud_id, point_id, x, y, z scaled), else zeros."""
    xyz = [F.col(c) for c in "xyz"]
    return align(tree, query.withColumn("key", F.when(lookup.in_bounds(depth, *xyz), xyz_to_key(*xyz, depth))), depth)


def linear(tree: StoredTree, query: DataFrame, depth: int) -> DataFrame:
    """``lookup.linear`` with bounds, from stored cells: points are dealt once, cells stay."""
    asked = _blocked(tree, lookup.placed(query, depth), depth, "place")
    return lookup.weighted(asked.join(tree.spark.table(tree.cells[depth]).hint("merge"), ["cloud_id", "block", "place"], "left"), tree.channels)


def interpolate(tree: StoredTree, query: DataFrame, depth: int, method: str = "linear", low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Features at points given in [low, high]."""
    size = (1 << depth) / (high - low)
    scaled = query.withColumns({c: (F.col(c) - F.lit(low)) * F.lit(size) for c in "xyz"})
    return {"linear": linear, "nearest": nearest}[method](tree, scaled, depth)


def neighbors(tree: StoredTree, depth: int, kernel: str = "333", nempty: bool = False) -> DataFrame:
    """(cloud_id, depth, key, k, nkey) of the neighbours that exist at stride 1; with nempty both ends are non-empty."""
    level = tree.level(depth).where("nempty" if nempty else "true").select("cloud_id", "block", "key")
    ends = level.select("cloud_id", F.col("block").alias("nblock"), F.col("key").alias("nkey"))
    there = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("nkey")) for k, v in enumerate(kernel_keys(F.col("key"), depth, kernel))])
    asked = level.select("cloud_id", "block", "key", F.explode(there).alias("o")).where("o.nkey is not null")
    asked = asked.select("cloud_id", "block", "key", "o.k", "o.nkey").withColumn("nblock", parent(F.col("nkey"), depth - tree.prefix))
    # a merge join may spill, and a broadcast would go by the level's size, not by that of what is asked
    inside = asked.where("nblock = block").drop("nblock").join(ends.withColumnRenamed("nblock", "block").hint("merge"), ["cloud_id", "block", "nkey"])
    across = tree.dealt(asked.where("nblock != block"), "nblock").join(ends.hint("merge"), ["cloud_id", "nblock", "nkey"])
    return inside.unionByName(across.drop("nblock")).select("cloud_id", F.lit(depth).alias("depth"), "key", "k", "nkey")


def max_pool(tree: StoredTree, depth: int) -> DataFrame:
    """``features.max_pool`` of the stored features, without a shuffle."""
    return features.max_pool(tree.feat(depth), depth, tree.channels, within=("cloud_id", "block")).drop("block")


def max_unpool(tree: StoredTree, depth: int) -> DataFrame:
    """The maxima over siblings of ``depth``, back at the non-empty nodes that have them, zeros at the others; without a shuffle."""
    best = features.max_pool(tree.feat(depth), depth, tree.channels, within=("cloud_id", "block"))
    level = tree.level(depth).where("nempty").select("cloud_id", "block", F.col("key").alias("own"), parent(F.col("key")).alias("key"))
    met = level.join(best.hint("merge"), ["cloud_id", "block", "key"])
    data = F.array(*[F.when(F.col("idx")[k] == F.col("own") % 8, F.col("data")[k]).otherwise(0.0) for k in range(tree.channels)])
    return met.select("cloud_id", F.lit(depth).alias("depth"), F.col("own").alias("key"), data.alias("data"))


def avg_pool(tree: StoredTree, depth: int) -> DataFrame:
    """Means over the siblings that have features, without a shuffle."""
    sums = tree.feat(depth).groupBy("cloud_id", "block", parent(F.col("key")).alias("key")).agg(F.count("*").alias("n"), *[F.sum(F.col("data")[k]).alias(f"s{k}") for k in range(tree.channels)])
    data = F.array(*[F.col(f"s{k}") / (F.col("n") + 1e-8) for k in range(tree.channels)])
    return sums.select("cloud_id", F.lit(depth - 1).alias("depth"), "key", data.alias("data"))


def nearest_upsample(tree: StoredTree, depth: int) -> DataFrame:
    """Non-empty nodes of ``depth`` + 1 with the feature of their parent, without a shuffle."""
    below = tree.level(depth + 1).where("nempty").select("cloud_id", "block", F.col("key").alias("own"), parent(F.col("key")).alias("key"))
    met = below.join(tree.feat(depth).select("cloud_id", "block", "key", "data").hint("merge"), ["cloud_id", "block", "key"])
    return met.select("cloud_id", F.lit(depth + 1).alias("depth"), F.col("own").alias("key"), "data")
