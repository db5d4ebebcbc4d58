"""Octrees as tables of Morton keys.

A level is the table of its nodes (cloud_id, depth, key, nempty, child); the leaves' averaged
signal is a table of its own. Levels are built from the distinct keys of the level below, which are
fewer at each step. Row positions (``child``) are running counts in key order, taken in two
steps over blocks of keys, so that one huge cloud is not one task. Levels above ``full_depth`` are complete,
and all their nodes count as non-empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.keys import axis_steps, key_to_xyz, normalized, parent, xyz_to_key
from voxmill.operators.points import normalize_box

#: Keys in a block of the running counts: 2 ** BLOCK.
BLOCK = 12


def voxelize(points: DataFrame, depth: int, low=-1.0, high=1.0) -> DataFrame:
    """The points with ``key`` and coordinates px, py, pz scaled to [0, 2 ** depth].

    The point to node map is the key column itself.
    """
    scaled = normalize_box(points.select("*", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).drop("x", "y", "z").withColumnsRenamed({"px": "x", "py": "y", "pz": "z"}), low, high, float(1 << depth))
    return scaled.withColumnsRenamed({"x": "px", "y": "py", "z": "pz"}).withColumn("key", xyz_to_key(F.col("px"), F.col("py"), F.col("pz"), depth))


def voxel_counts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("cloud_id", "key").agg(F.count("*").alias("npt"))


def average_signal(voxels: DataFrame, channels: int) -> DataFrame:
    """Leaves: npt, mean scaled coordinates, normalised sum of normals, mean features of known width."""
    sums = voxels.groupBy("cloud_id", "key").agg(
        F.count("*").alias("npt"), *[F.avg(c).alias(c) for c in ("px", "py", "pz")], *[F.sum(c).alias(c) for c in ("nx", "ny", "nz")],
        *[F.avg(F.col("features")[k]).alias(f"__f{k}") for k in range(channels)],
    )
    normal = dict(zip(("nx", "ny", "nz"), normalized(F.col("nx"), F.col("ny"), F.col("nz"))))
    features = F.array(*[F.col(f"__f{k}") for k in range(channels)]).cast("array<double>")
    return sums.withColumns(normal).select("cloud_id", "key", "npt", "px", "py", "pz", "nx", "ny", "nz", features.alias("features"))


def level_keys(leaves: DataFrame, depth: int, first: int = 0) -> dict[int, DataFrame]:
    """Distinct non-empty keys (cloud_id, key) of the levels from ``depth`` to ``first``."""
    levels = {depth: leaves.select("cloud_id", "key").distinct()}
    for d in range(depth - 1, first - 1, -1):
        levels[d] = levels[d + 1].select("cloud_id", parent(F.col("key")).alias("key")).distinct()
    return levels


def full_level(clouds: DataFrame, depth: int) -> DataFrame:
    """All keys of a complete level for each cloud."""
    return clouds.select("cloud_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8**depth - 1).cast("long"))).alias("key"))


def children(parents: DataFrame) -> DataFrame:
    """The eight children of each (cloud_id, key)."""
    return parents.select("cloud_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.shiftleft("key", 3) + k)).alias("key"))


def child_index(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``child``: the node's rank among the non-empty ones of its cloud and depth, -1 if empty.

    Counts of key blocks are summed first; ranks are then taken within a block.
    """
    blocked = nodes.withColumn("block", F.shiftright("key", block))
    counts = blocked.groupBy("cloud_id", "depth", "block").agg(F.count_if("nempty").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cloud_id", "depth").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("cloud_id", "depth", "block", before.alias("start"))
    within = F.sum(F.col("nempty").cast("long")).over(Window.partitionBy("cloud_id", "depth", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocked.withColumn("rank", within).join(starts, ["cloud_id", "depth", "block"])
    return ranked.withColumn("child", F.when(F.col("nempty"), F.col("start") + F.col("rank") - 1).otherwise(F.lit(-1)).cast("long")).drop("block", "start", "rank")


def build_nodes(voxels: DataFrame, depth: int, full_depth: int, index: bool = True) -> DataFrame:
    """All nodes of the levels 0 to depth; without ``index`` there is no ``child``.

    One pass over the points and no join: occupied keys of all levels are made distinct, each says that it is there
    and that its eight children exist, the root stands in for the complete levels, and what is said of a
    node is put together in one grouped aggregation.
    """
    leaves = voxels.select("cloud_id", "key").distinct()
    d = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    occupied = leaves.select("cloud_id", "key", d.alias("depth")).select("cloud_id", "depth", F.expr(f"shiftright(key, 3 * ({depth} - depth))").alias("key")).distinct()
    says = lambda at, key, there: F.struct(at.alias("depth"), key.cast("long").alias("key"), there.alias("nempty"))
    here = F.array(says(F.col("depth"), F.col("key"), F.lit(True)))
    below = F.when(F.col("depth") < depth, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: says(F.col("depth") + 1, F.shiftleft("key", 3) + k, F.lit(False)))).otherwise(F.slice(here, 1, F.lit(0)))
    level = lambda k: F.transform(F.sequence(F.lit(0), F.lit(8**k - 1)), lambda n: says(F.lit(k), n, F.lit(k < full_depth)))
    top = F.concat(*[level(k) for k in range(full_depth + 1)])
    said = F.concat(F.when((F.col("depth") >= full_depth), F.concat(here, below)).otherwise(F.slice(here, 1, F.lit(0))), F.when(F.col("depth") == 0, top).otherwise(F.slice(here, 1, F.lit(0))))
    nodes = occupied.select("cloud_id", F.explode(said).alias("n")).select("cloud_id", "n.*").groupBy("cloud_id", "depth", "key").agg(F.max("nempty").alias("nempty"))
    return child_index(nodes).select("cloud_id", "depth", "key", "nempty", "child") if index else nodes


def init_octree(clouds: DataFrame, full_depth: int) -> DataFrame:
    """Complete levels only."""
    parts = [full_level(clouds, d).withColumn("depth", F.lit(d)).withColumn("nempty", F.lit(True)) for d in range(full_depth + 1)]
    return reduce(DataFrame.unionByName, parts).select("cloud_id", "depth", "key", "nempty", F.col("key").alias("child"))


def nempty_index(nodes: DataFrame) -> DataFrame:
    """Non-empty nodes with ``idx``, their row position among all nodes of cloud and depth."""
    everything = child_index(nodes.select("cloud_id", "depth", "key", F.col("nempty").alias("__is"), F.lit(True).alias("nempty")))
    return everything.where("__is").select("cloud_id", "depth", "key", F.col("child").alias("idx"))


def positions(nodes: DataFrame, nempty: bool = False) -> DataFrame:
    """(cloud_id, depth, key, idx): row positions of all, or of the non-empty, nodes of cloud and depth."""
    if nempty:
        return nodes.where("nempty").select("cloud_id", "depth", "key", F.col("child").alias("idx"))
    return child_index(nodes.select("cloud_id", "depth", "key", F.lit(True).alias("nempty"))).select("cloud_id", "depth", "key", F.col("child").alias("idx"))


def node_counts(nodes: DataFrame) -> DataFrame:
    """nnum and nnum_nempty by depth and cloud, by depth (cloud null), and of all (both null)."""
    return nodes.rollup("depth", "cloud_id").agg(F.count("*").alias("nnum"), F.count_if("nempty").alias("nnum_nempty"))


def merge_octrees(nodes: DataFrame) -> DataFrame:
    """A batch from trees of equal depth: clouds numbered 0.. by id, children counted across clouds."""
    counts = nodes.groupBy("depth", "cloud_id").agg(F.count_if("nempty").alias("n"))
    window = Window.partitionBy("depth").orderBy("cloud_id")
    before = F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("depth", "cloud_id", before.alias("shift"), (F.row_number().over(window) - 1).alias("batch_id"))
    moved = nodes.join(shifts, ["depth", "cloud_id"])
    return moved.select("batch_id", "depth", "key", "nempty", F.when(F.col("nempty"), F.col("child") + F.col("shift")).otherwise(F.lit(-1)).cast("long").alias("child"))


def split(nodes: DataFrame, flags: DataFrame, depth: int) -> DataFrame:
    """The level ``depth`` with nempty taken from flags (cloud_id, key, split 0 or 1).

    If nothing is split, the first node of the first cloud is.
    """
    level = nodes.where(F.col("depth") == depth).select("cloud_id", "depth", "key")
    marked = level.join(flags.select("cloud_id", "key", "split"), ["cloud_id", "key"], "left").withColumn("nempty", F.coalesce(F.col("split") != 0, F.lit(False)))
    whole = marked.agg(F.min(F.struct("cloud_id", "key")).alias("first"), F.coalesce(F.bool_or("nempty"), F.lit(False)).alias("some"))
    forced = marked.crossJoin(F.broadcast(whole))  # one row
    is_first = ~F.col("some") & (F.struct("cloud_id", "key") == F.col("first"))
    return child_index(forced.withColumn("nempty", F.col("nempty") | is_first).select("cloud_id", "depth", "key", "nempty"))


def grow(level: DataFrame) -> DataFrame:
    """The next level: the children of all non-empty nodes, all marked non-empty."""
    made = children(level.where("nempty").select("cloud_id", "key"))
    deeper = made.withColumn("nempty", F.lit(True)).crossJoin(F.broadcast(level.agg((F.max("depth") + 1).alias("depth"))))  # one row
    return child_index(deeper.select("cloud_id", "depth", "key", "nempty"))


def node_xyz(nodes: DataFrame) -> DataFrame:
    x, y, z = key_to_xyz(F.col("key"))
    return nodes.select("*", x.alias("x"), y.alias("y"), z.alias("z"))


def to_points(leaves: DataFrame, depth: int, rescale: bool = True) -> DataFrame:
    """Average points, or cell centres where there is none, scaled to [-1, 1]."""
    centres = [c + 0.5 for c in key_to_xyz(F.col("key"), depth)]
    at = {n: F.coalesce(F.col(p), c) for n, p, c in zip("xyz", ("px", "py", "pz"), centres)}
    if rescale:
        at = {n: v * 2.0 ** (1 - depth) - 1.0 for n, v in at.items()}
    return leaves.withColumns(at)


def input_feature(leaves: DataFrame, depth: int, which: str) -> DataFrame:
    """``data``: of N normal, D displacement, L local and P global coordinates, F features; in this order."""
    local = [F.col(c) - F.floor(c) - 0.5 for c in ("px", "py", "pz")]
    normal = [F.col(c) for c in ("nx", "ny", "nz")]
    parts: list[Column] = []
    if "N" in which:
        parts.append(F.array(*normal))
    if "D" in which:
        parts.append(F.array(local[0] * normal[0] + local[1] * normal[1] + local[2] * normal[2]))
    if "L" in which:
        parts.append(F.array(*local))
    if "P" in which:
        parts.append(F.array(*[F.col(c) * 2.0 ** (1 - depth) - 1.0 for c in ("px", "py", "pz")]))
    if "F" in which:
        parts.append(F.col("features"))
    return leaves.select("cloud_id", F.lit(depth).alias("depth"), "key", F.concat(*parts).alias("data"))


def range_grid(rows: DataFrame, low: int, high: int) -> DataFrame:
    """``rows``, each with all integer points x, y, z of the closed cube [low, high]^3."""
    side = F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))
    return rows.withColumn("x", F.explode(side)).withColumn("y", F.explode(side)).withColumn("z", F.explode(side))


def kernel_offsets(kernel: str = "333") -> list[int]:
    """Which of the 27 neighbours (k = 9 (dx+1) + 3 (dy+1) + dz+1) a kernel takes, in its order."""
    ranges = [{"1": (1,), "2": (1, 2), "3": (0, 1, 2)}[c] for c in kernel]
    return [9 * a + 3 * b + c for a in ranges[0] for b in ranges[1] for c in ranges[2]]


def kernel_keys(key: Column, depth: int, kernel: str, back: bool = False) -> list[Column]:
    """The key one kernel offset on (or back) for each offset of the kernel; null beyond the cube."""
    steps = [axis_steps(key, axis, depth) for axis in range(3)]
    at = (lambda n: 2 - n) if back else (lambda n: n)
    return [steps[0][at(o // 9)].bitwiseOR(steps[1][at(o // 3 % 3)]).bitwiseOR(steps[2][at(o % 3)]) for o in kernel_offsets(kernel)]


def neighbors(nodes: DataFrame, depth: int, kernel: str = "333", stride: int = 1, nempty: bool = False) -> DataFrame:
    """(cloud_id, depth, key, k, nkey) of the neighbours that exist, k counted within the kernel.

    With stride 2 rows are the first siblings, named by their parent's key. With nempty both ends
    are non-empty at stride 1, the neighbour at stride 2. Offsets outside the kernel are never made.
    """
    level = nodes.where(F.col("depth") == depth)
    ends = (level.where("nempty") if nempty else level).select("cloud_id", F.col("key").alias("nkey"))
    rows = level.where(F.col("key") % 8 == 0) if stride == 2 else level.where("nempty") if nempty else level
    there = kernel_keys(F.col("key"), depth, kernel)
    wide = rows.select("cloud_id", "key", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("nkey")) for k, v in enumerate(there)])).alias("o"))
    asked = wide.select("cloud_id", "key", "o.k", "o.nkey").where("nkey is not null")
    # the exploded side is many times what its input suggests, so it must not be broadcast; a merge join may spill
    found = asked.join(ends.hint("merge"), ["cloud_id", "nkey"])
    key = parent(F.col("key")) if stride == 2 else F.col("key")
    return found.select("cloud_id", F.lit(depth).alias("depth"), key.alias("key"), "k", "nkey")
