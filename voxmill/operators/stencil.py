"""Stencils over neighbourhoods with given weights.

A node's key says which rows have it as a neighbour, so features are sent to those rows without a join,
multiplied on the way, and summed by row: one shuffle, of partial sums. What no row asked for is dropped by a semi-join on the
same key, which moves the nodes only. Features are those of non-empty nodes where ``nempty`` says so. Weights
(kernel size x channels x channels, part of the query, not of the data) are broadcast. For wide channels see ``blocks``.
"""

from __future__ import annotations

from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.keys import parent, zeros
from voxmill.operators.octree import kernel_keys


def rows_of(nodes: DataFrame, depth: int, stride: int, nempty: bool) -> DataFrame:
    """(cloud_id, key) of the rows that a stencil has: nodes, or at stride 2 the parents of siblings."""
    level = nodes.where(F.col("depth") == depth)
    if stride == 2:
        return level.where(F.col("key") % 8 == 0).select("cloud_id", parent(F.col("key")).alias("key"))
    return (level.where("nempty") if nempty else level).select("cloud_id", "key")


def reached(feat: DataFrame, depth: int, kernel: str = "333", stride: int = 1) -> DataFrame:
    """(cloud_id, key, k, data): each node's feature sent to the rows whose k-th neighbour it is, by arithmetic on keys.

    Nothing is joined; keys of rows that don't exist are among them.
    """
    there = [F.struct(F.lit(k).alias("k"), v.alias("key")) for k, v in enumerate(kernel_keys(F.col("key"), depth, kernel, back=True))]
    sent = feat.select("cloud_id", "data", F.explode(F.array(*there)).alias("o")).where("o.key is not null")
    if stride == 2:
        sent = sent.where(F.col("o.key") % 8 == 0)
    return sent.select("cloud_id", (parent(F.col("o.key")) if stride == 2 else F.col("o.key")).alias("key"), "o.k", "data")


def columns(feat: DataFrame, nodes: DataFrame, depth: int, kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """(cloud_id, key, k, data): the neighbours' features in long format; absent rows stand for zeros."""
    sent = reached(feat, depth, kernel, stride)
    return sent.join(rows_of(nodes, depth, stride, nempty).hint("merge"), ["cloud_id", "key"], "left_semi")


def scatter_columns(cols: DataFrame, nodes: DataFrame, depth: int, channels: int, kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """The reverse of ``columns``: each neighbour's sum of what rows hold for it."""
    own = F.shiftleft("key", 3) if stride == 2 else F.col("key")
    there = F.get(F.array(*kernel_keys(own, depth, kernel)), F.col("k"))
    sums = cols.select("cloud_id", there.alias("key"), "data").groupBy("cloud_id", "key").agg(*[F.sum(F.col("data")[c]).alias(f"s{c}") for c in range(channels)])
    level = nodes.where(F.col("depth") == depth)
    met = sums.join((level.where("nempty") if nempty else level).select("cloud_id", "key"), ["cloud_id", "key"], "left_semi")
    return met.select("cloud_id", F.lit(depth).alias("depth"), "key", F.array(*[F.col(f"s{c}") for c in range(channels)]).alias("data"))


def _weights(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """The weight table (k, w): w is the flat matrix of kernel position k."""
    return df.sparkSession.createDataFrame([(k, [float(v) for v in w.ravel()]) for k, w in enumerate(weights)], "k int, w array<double>")


def _products(met: DataFrame, weights: np.ndarray, transpose: bool = False) -> DataFrame:
    """(cloud_id, key, sums) of data times the weight matrix of k."""
    cin, cout = weights.shape[1:]
    if transpose:
        cin, cout = cout, cin
    at = (lambda i, o: o * cin + i) if transpose else (lambda i, o: i * cout + o)
    terms = [sum((F.col("data")[i] * F.col("w")[at(i, o)] for i in range(cin)), F.lit(0.0)) for o in range(cout)]
    joined = met.join(F.broadcast(_weights(met, weights)), "k")
    sums = joined.groupBy("cloud_id", "key").agg(*[F.sum(t).alias(f"s{o}") for o, t in enumerate(terms)])
    return sums.select("cloud_id", "key", F.array(*[F.col(f"s{o}") for o in range(cout)]).alias("data"))


def conv(feat: DataFrame, nodes: DataFrame, depth: int, weights: np.ndarray, bias: list[float] | None = None, kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """out[i] = sum over k of data[neighbour(i, k)] weights[k] + bias.

    Rows: the non-empty nodes (stride 1 and nempty), all nodes (stride 1), the parents (stride 2
    and nempty), or all nodes of the level above, zeros and bias where there are no children.
    """
    cout = weights.shape[2]
    out = _products(reached(feat, depth, kernel, stride), weights)
    if nempty:
        out = out.join(rows_of(nodes, depth, stride, nempty), ["cloud_id", "key"], "left_semi")
    else:
        rows = nodes.where(F.col("depth") == (depth - 1 if stride == 2 else depth)).select("cloud_id", "key")
        out = rows.join(out, ["cloud_id", "key"], "left").withColumn("data", F.coalesce("data", zeros(cout)))
    data = F.array(*[F.col("data")[o] + F.lit(float((bias or [0.0] * cout)[o])) for o in range(cout)])
    return out.select("cloud_id", F.lit(depth - 1 if stride == 2 else depth).alias("depth"), "key", data.alias("data"))


def deconv(feat: DataFrame, nodes: DataFrame, depth: int, weights: np.ndarray, kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """The transpose: each row adds data times the transposed weights[k] to its neighbour k.

    With stride 2 rows are at ``depth`` and neighbours at depth + 1. Only nodes that receive something are returned.
    """
    deep = depth + 1 if stride == 2 else depth
    own = F.shiftleft("key", 3) if stride == 2 else F.col("key")
    there = [F.struct(F.lit(k).alias("k"), v.alias("key")) for k, v in enumerate(kernel_keys(own, deep, kernel))]
    sent = feat.select("cloud_id", "data", F.explode(F.array(*there)).alias("o")).where("o.key is not null").select("cloud_id", "o.key", "o.k", "data")
    sums = _products(sent, weights, transpose=True)
    level = nodes.where(F.col("depth") == deep)
    met = sums.join((level.where("nempty") if nempty else level).select("cloud_id", "key"), ["cloud_id", "key"], "left_semi")
    return met.select("cloud_id", F.lit(deep).alias("depth"), "key", "data")


def depthwise_conv(feat: DataFrame, nodes: DataFrame, depth: int, weights: np.ndarray, kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """out[i, c] = sum over k of data[neighbour(i, k), c] weights[k, c]."""
    channels = weights.shape[1]
    joined = reached(feat, depth, kernel, stride).join(F.broadcast(_weights(feat, weights)), "k")
    sums = joined.groupBy("cloud_id", "key").agg(*[F.sum(F.col("data")[c] * F.col("w")[c]).alias(f"s{c}") for c in range(channels)])
    met = sums.join(rows_of(nodes, depth, stride, nempty), ["cloud_id", "key"], "left_semi")
    return met.select("cloud_id", F.lit(depth - 1 if stride == 2 else depth).alias("depth"), "key", F.array(*[F.col(f"s{c}") for c in range(channels)]).alias("data"))


def group_conv(feat: DataFrame, nodes: DataFrame, depth: int, weights: list[np.ndarray], kernel: str = "333", stride: int = 1, nempty: bool = True) -> DataFrame:
    """Slices of the channels convolved each with its own weights, joined up again: one pass with block weights."""
    size, cin, cout = len(weights[0]), sum(w.shape[1] for w in weights), sum(w.shape[2] for w in weights)
    whole, i, o = np.zeros((size, cin, cout)), 0, 0
    for w in weights:
        whole[:, i : i + w.shape[1], o : o + w.shape[2]] = w
        i, o = i + w.shape[1], o + w.shape[2]
    return conv(feat, nodes, depth, whole, None, kernel, stride, nempty)


def linear(feat: DataFrame, weights: np.ndarray, bias: list[float] | None = None) -> DataFrame:
    """A matrix product for each row (1 x 1 convolution)."""
    shift = np.asarray(bias if bias is not None else np.zeros(weights.shape[1]))

    def product(data: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(data.to_list()) @ weights + shift)) if len(data) else data

    product.__annotations__ = {"data": pd.Series, "return": pd.Series}
    return feat.withColumn("data", F.pandas_udf(product, "array<double>")(F.col("data")))


def example_weights(*shape: int) -> np.ndarray:
    """Small weights by rule: ((7 n + 3) mod 11 - 5) / 10 for the n-th number."""
    return (((7 * np.arange(prod(shape)) + 3) % 11 - 5) / 10.0).reshape(shape)
