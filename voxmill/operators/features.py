"""Pooling, norms, up-sampling and reductions of node features (cloud_id, depth, key, data).

The width of ``data`` is a parameter, so that sums run over plain columns with partial
aggregation instead of exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.keys import key_to_xyz, parent, uniform, vector_avg, vector_sum, zeros
from voxmill.operators.lookup import align, interpolate
from voxmill.operators.stencil import reached, rows_of

NODE = ["cloud_id", "depth", "key"]


def pad(feat: DataFrame, nodes: DataFrame, depth: int, channels: int, value: float = 0.0) -> DataFrame:
    """Features of all nodes of the level, ``value`` where there are none."""
    level = nodes.where(F.col("depth") == depth).select(*NODE)
    return level.join(feat.select(*NODE, "data"), NODE, "left").withColumn("data", F.coalesce("data", zeros(channels, value)))


def depad(feat: DataFrame, nodes: DataFrame) -> DataFrame:
    """Features of non-empty nodes only."""
    return feat.join(nodes.where("nempty").select(*NODE), NODE, "left_semi")


def max_pool(feat: DataFrame, depth: int, channels: int, nodes: DataFrame | None = None, within: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    """Maxima over siblings, with ``idx``, which sibling (0..7, the first on ties) has it.

    With ``nodes``, empty parents get zeros and no index. ``within`` may name more columns, by which the rows are dealt already, such as blocks; they come back.
    """
    sibling = F.col("key") % 8
    best = [F.max(F.struct(F.col("data")[k].alias("v"), (-sibling).alias("s"))).alias(f"m{k}") for k in range(channels)]
    out = feat.groupBy(*within, parent(F.col("key")).alias("key")).agg(*best)
    out = out.select("cloud_id", F.lit(depth - 1).alias("depth"), "key", F.array(*[F.col(f"m{k}.v") for k in range(channels)]).alias("data"), F.array(*[(-F.col(f"m{k}.s")).cast("int") for k in range(channels)]).alias("idx"), *within[1:])
    if nodes is None:
        return out
    level = nodes.where(F.col("depth") == depth - 1).select(*NODE)
    return level.join(out, NODE, "left").withColumn("data", F.coalesce("data", zeros(channels)))


def max_unpool(pooled: DataFrame, depth: int, channels: int, nodes: DataFrame | None = None) -> DataFrame:
    """Values back at the children of ``depth`` + 1 where the maxima were, zeros elsewhere; with ``nodes`` for non-empty children only."""
    wide = pooled.where(F.col("idx").isNotNull()).select("cloud_id", "key", "data", "idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"))
    data = F.array(*[F.when(F.col("idx")[k] == F.col("s"), F.col("data")[k]).otherwise(0.0) for k in range(channels)])
    out = wide.select("cloud_id", F.lit(depth + 1).alias("depth"), (F.shiftleft("key", 3) + F.col("s")).alias("key"), data.alias("data"))
    return out if nodes is None else depad(out, nodes)


def avg_pool(feat: DataFrame, nodes: DataFrame, depth: int, channels: int, kernel: str = "222", stride: int = 2, nempty: bool = False) -> DataFrame:
    """Means over the neighbours that exist; rows without any are absent."""
    sent = reached(feat, depth, kernel, stride)
    sums = sent.groupBy("cloud_id", "key").agg(F.count("*").alias("n"), *[F.sum(F.col("data")[k]).alias(f"s{k}") for k in range(channels)])
    sums = sums.join(rows_of(nodes, depth, stride, nempty), ["cloud_id", "key"], "left_semi")
    data = F.array(*[F.col(f"s{k}") / (F.col("n") + 1e-8) for k in range(channels)])
    return sums.select("cloud_id", F.lit(depth - 1 if stride == 2 else depth).alias("depth"), "key", data.alias("data"))


def global_pool(feat: DataFrame, clouds: DataFrame, channels: int) -> DataFrame:
    """Mean of each cloud, zeros for clouds without nodes."""
    means = feat.groupBy("cloud_id").agg(vector_avg("data", channels).alias("data"))
    return clouds.select("cloud_id").join(means, "cloud_id", "left").withColumn("data", F.coalesce("data", zeros(channels)))


def batch_norm(feat: DataFrame, channels: int, gamma: list[float], beta: list[float], eps: float = 1e-5) -> DataFrame:
    """Each channel over all rows (biased variance), scaled and shifted."""
    stats = feat.agg(*[f(F.col("data")[k]).alias(f"{n}{k}") for n, f in (("m", F.avg), ("v", F.var_pop)) for k in range(channels)])
    data = [(F.col("data")[k] - F.col(f"m{k}")) / F.sqrt(F.col(f"v{k}") + eps) * gamma[k] + beta[k] for k in range(channels)]
    return feat.crossJoin(F.broadcast(stats)).select(*NODE, F.array(*data).alias("data"))  # one row


def group_norm(feat: DataFrame, channels: int, groups: int, gamma: list[float], beta: list[float], least: int = 4, eps: float = 1e-5) -> DataFrame:
    """Each group of channels within a cloud; fewer groups if they had under ``least`` channels."""
    if channels // groups < least:
        groups = max(1, channels // least)
    size = channels // groups
    sums = feat.groupBy("cloud_id").agg(F.count("*").alias("n"), *[F.sum(sum_over(g, size)).alias(f"s{g}") for g in range(groups)])
    means = sums.select("cloud_id", "n", *[(F.col(f"s{g}") / (F.col("n") * size + eps)).alias(f"m{g}") for g in range(groups)])
    centred = feat.join(means, "cloud_id").select(*NODE, "n", F.array(*[F.col("data")[k] - F.col(f"m{k // size}") for k in range(channels)]).alias("data"))
    spread = centred.groupBy("cloud_id").agg(F.max("n").alias("n"), *[F.sum(sum_over(g, size, square=True)).alias(f"q{g}") for g in range(groups)])
    scales = spread.select("cloud_id", *[(F.lit(1.0) / F.sqrt(F.col(f"q{g}") / (F.col("n") * size + eps) + eps)).alias(f"r{g}") for g in range(groups)])
    data = [F.col("data")[k] * F.col(f"r{k // size}") * gamma[k] + beta[k] for k in range(channels)]
    return centred.join(scales, "cloud_id").select(*NODE, F.array(*data).alias("data"))


def sum_over(group: int, size: int, square: bool = False) -> Column:
    parts = [F.col("data")[k] for k in range(group * size, (group + 1) * size)]
    total = F.lit(0.0)
    for p in parts:
        total = total + (p * p if square else p)
    return total


def instance_norm(feat: DataFrame, channels: int, gamma: list[float], beta: list[float], eps: float = 1e-5) -> DataFrame:
    return group_norm(feat, channels, channels, gamma, beta, least=1, eps=eps)


def drop_path(feat: DataFrame, prob: float, seed: int, per: str = "cloud") -> DataFrame:
    """Multiply by a seeded Bernoulli(keep) / keep, drawn for each cloud or each row."""
    keep = 1.0 - prob
    parts = [F.col("cloud_id")] if per == "cloud" else [F.col("cloud_id"), F.col("key")]
    factor = F.when(uniform(seed, *parts) < keep, 1.0 / keep).otherwise(0.0)
    return feat.withColumn("data", F.transform("data", lambda v: v * factor))


def nearest_upsample(feat: DataFrame, depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """Children take their parent's feature; with ``nodes``, non-empty children only."""
    wide = feat.select("cloud_id", "key", "data", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"))
    out = wide.select("cloud_id", F.lit(depth + 1).alias("depth"), (F.shiftleft("key", 3) + F.col("s")).alias("key"), "data")
    return out if nodes is None else depad(out, nodes)


def upsample(feat: DataFrame, nodes: DataFrame, depth: int, target: int, channels: int, method: str = "linear", nempty: bool = True) -> DataFrame:
    """Features of ``depth`` at the cell centres of ``target``."""
    level = nodes.where((F.col("depth") == target) & (F.col("nempty") if nempty else F.lit(True)))
    x, y, z = [(c + 0.5) * 2.0 ** (depth - target) for c in key_to_xyz(F.col("key"), target)]
    query = level.select("cloud_id", F.col("key").alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"))
    found = interpolate(feat, query, depth, channels, method, 0.0, float(1 << depth))
    return found.select("cloud_id", F.lit(target).alias("depth"), F.col("point_id").alias("key"), "data")


def to_voxels(feat: DataFrame, clouds: DataFrame, depth: int, channels: int) -> DataFrame:
    """The dense grid of each cloud: cloud_id, x, y, z, data (zeros where absent)."""
    spine = clouds.select("cloud_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8**depth - 1).cast("long"))).alias("key"))
    x, y, z = key_to_xyz(F.col("key"), depth)
    return align(feat, spine, channels).select("cloud_id", x.alias("x"), y.alias("y"), z.alias("z"), "data")


def scatter_add(src: DataFrame, size: int, channels: int) -> DataFrame:
    """Sums of ``data`` by ``index``, zeros for indices up to ``size`` that don't occur."""
    sums = src.groupBy("index").agg(vector_sum("data", channels).alias("data"))
    spine = src.sparkSession.range(size).withColumnRenamed("id", "index")
    return spine.join(sums, "index", "left").withColumn("data", F.coalesce("data", zeros(channels)))


