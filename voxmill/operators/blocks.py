"""Stencils with wide channels, by blocks of space.

The rows of a level are cut into cubes of 8 ** height keys. Each node is copied to the (at most eight) blocks whose rows it reaches, so
that a block holds its rows and the rim around them: the rim is what neighbouring blocks exchange, in the direction the stencil
takes (rows gather from neighbours, or, transposed, neighbours send to rows). Blocks are dealt and sorted by one shuffle and read as a stream;
as many whole blocks as make up ROWS rows are worked out at once, so that many small blocks (a deep, sparse level) cost no more than few
full ones: each kernel position is one matrix product over all rows that have that neighbour, with NumPy. Nothing grows with the
channels but the rows' width, where the join form of ``stencil`` writes each product out as columns.

A block holds at most 8 ** height rows and their rim, whatever the cloud; blocks that have rim but no rows give no rows.
Results are those of the functions of the same name in ``stencil``, up to the order in which doubles are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.keys import parent
from voxmill.operators.octree import kernel_keys, kernel_offsets
from voxmill.operators.stencil import rows_of

SCHEMA = "cloud_id bigint, depth int, key bigint, data array<double>"
NAMES = ["cloud_id", "depth", "key", "data"]
#: Rows that are held before the blocks that they make up are worked out.
ROWS = 1 << 16
#: What a kernel position does to the features (rows x channels) that stand there.
Product = Callable[[int, np.ndarray], np.ndarray]


def reached_rows(depth: int, kernel: str, stride: int, transposed: bool) -> list[Column]:
    """Keys of the rows that a node ``key`` of level ``depth`` reaches, for each kernel position; null where there is none."""
    if not transposed:
        back = kernel_keys(F.col("key"), depth, kernel, back=True)
        return [F.when(v % 8 == 0, parent(v)) for v in back] if stride == 2 else back
    return kernel_keys(F.shiftleft("key", 3), depth + 1, kernel) if stride == 2 else kernel_keys(F.col("key"), depth, kernel)


def coordinates(keys: np.ndarray, depth: int) -> np.ndarray:
    return np.stack([reduce(np.bitwise_or, [((keys >> (3 * i + s)) & 1) << i for i in range(depth)], np.zeros_like(keys)) for s in (2, 1, 0)], 1)


def morton(at: np.ndarray, depth: int) -> np.ndarray:
    return reduce(np.bitwise_or, [((at[:, a] >> i) & 1) << (3 * i + 2 - a) for i in range(depth) for a in range(3)], np.zeros(len(at), np.int64))


def sources(rows: np.ndarray, offset: tuple[int, int, int], stride: int, transposed: bool, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the source of each row (coordinates) stands for a kernel offset, and whether there can be one."""
    if not transposed:
        at = rows * stride + offset
        return at, ((at >= 0) & (at < bound)).all(1)
    at = rows - np.array(offset)
    return at // stride, ((at >= 0) & (at < bound * stride) & (at % stride == 0)).all(1)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def stencil_blocks(feat: DataFrame, rows: DataFrame | None, depth: int, channels: int, product: Product, kernel: str, stride: int = 1, transposed: bool = False, keep: bool = False, bias: list[float] | None = None, height: int = 3) -> DataFrame:
    """``product`` summed over the kernel for ``rows`` (cloud_id, key); those without any source are dropped, or kept as zeros with ``keep``.

    ``feat`` is of level ``depth``; rows are of that level, of the one above (stride 2) or of the one below (stride 2, transposed).
    Without ``rows`` (stride 1) they are those of ``feat``, which is then read once: a node asks where its own block holds it.
    """
    out_depth = depth + (0 if stride == 1 else 1 if transposed else -1)
    offsets = [(o // 9 - 1, o // 3 % 3 - 1, o % 3 - 1) for o in kernel_offsets(kernel)]
    home, there = parent(F.col("key"), height), [parent(v, height) for v in reached_rows(depth, kernel, stride, transposed)]
    blocks = F.array_compact(F.array_distinct(F.array(*there, *([home] if rows is None else []))))
    own = F.col("cloud_id").cast("long").alias("cloud_id")
    moved = feat.select(own, "key", "data", F.explode(blocks).alias("block"), F.lit(True).alias("held"))
    if rows is None:
        moved = moved.withColumn("asks", F.col("block") == home)
    else:
        asked = rows.select(own, "key", F.lit(None).cast("array<double>").alias("data"), home.alias("block"), F.lit(False).alias("held"), F.lit(True).alias("asks"))
        moved = moved.withColumn("asks", F.lit(False)).unionByName(asked)
    shift = np.array(bias if bias is not None else [0.0] * channels)
    bound, span = 1 << depth, 3 * depth

    def worked_out(part: pa.Table) -> pa.RecordBatch:
        """Whole blocks, one after another, all at once: a node is told by its block's number and its key."""
        cloud, block, key, here, asks = (part[c].combine_chunks() for c in ("cloud_id", "block", "key", "held", "asks"))
        number, key, here = numbered(cloud, block), np.asarray(key), here.to_numpy(zero_copy_only=False)
        ask = np.flatnonzero(asks.to_numpy(zero_copy_only=False))
        held = (number[here] << span) | key[here]
        out, met = np.zeros((len(ask), channels)), np.zeros(len(ask), bool)
        if len(held) and len(ask):
            data = np.asarray(part["data"].combine_chunks().flatten()).reshape(len(held), -1)
            at = coordinates(key[ask], out_depth)
            for k, offset in enumerate(offsets):
                there, inside = sources(at, offset, stride, transposed, bound)
                code = (number[ask] << span) | morton(there, depth)
                spot = np.minimum(np.searchsorted(held, code), len(held) - 1)
                hit = np.flatnonzero(inside & (held[spot] == code))
                out[hit] += product(k, data[spot[hit]])
                met[hit] = True
        kept = np.arange(len(ask)) if keep else np.flatnonzero(met)
        return pa.RecordBatch.from_arrays([cloud.take(pa.array(ask[kept])), pa.array(np.full(len(kept), out_depth, np.int32)), pa.array(key[ask[kept]]), lists(out[kept] + shift)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            cuts = block_starts(table, 1 << (62 - span))
            for i, j in zip(cuts, cuts[1:]):
                yield worked_out(table.slice(i, j - i))
            held = table.slice(cuts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            cuts = [*block_starts(table, 1 << (62 - span)), len(table)]
            for i, j in zip(cuts, cuts[1:]):
                yield worked_out(table.slice(i, j - i))

    dealt = moved.repartition("cloud_id", "block").sortWithinPartitions("cloud_id", "block", "key")
    return dealt.mapInArrow(run, SCHEMA)


def numbered(cloud: pa.Array, block: pa.Array) -> np.ndarray:
    """The number of each row's block, counted from 0; rows of a block follow each other."""
    a, b = np.asarray(cloud), np.asarray(block)
    return np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])


def block_starts(table: pa.Table, most: int) -> list[int]:
    """Rows at which a block starts: the first, every ``most``-th after it, and the last."""
    number = numbered(table["cloud_id"].combine_chunks(), table["block"].combine_chunks())
    firsts = np.flatnonzero(np.diff(number, prepend=-1))
    return sorted({*firsts[::most].tolist(), *firsts[-1:].tolist()})


def _rows(nodes: DataFrame | None, depth: int, stride: int, nempty: bool) -> DataFrame | None:
    if nodes is None and (stride != 1 or not nempty):
        raise ValueError("only the non-empty rows of stride 1 are known without nodes")
    if nodes is None:
        return None
    if nempty:
        return rows_of(nodes, depth, stride, nempty)
    return nodes.where(F.col("depth") == (depth - 1 if stride == 2 else depth)).select("cloud_id", "key")


def conv_blocks(feat: DataFrame, depth: int, weights: np.ndarray, kernel: str = "333", height: int = 3, nodes: DataFrame | None = None, bias: list[float] | None = None, stride: int = 1, nempty: bool = True) -> DataFrame:
    """``stencil.conv`` by blocks. Without ``nodes`` the rows are those of ``feat`` (stride 1)."""
    rows = _rows(nodes, depth, stride, nempty)
    return stencil_blocks(feat, rows, depth, weights.shape[2], lambda k, x: x @ weights[k], kernel, stride, keep=not nempty, bias=bias, height=height)


def deconv_blocks(feat: DataFrame, nodes: DataFrame, depth: int, weights: np.ndarray, kernel: str = "333", height: int = 3, stride: int = 1, nempty: bool = True) -> DataFrame:
    """``stencil.deconv`` by blocks: rows gather what their neighbours send them."""
    level = nodes.where(F.col("depth") == (depth + 1 if stride == 2 else depth))
    rows = (level.where("nempty") if nempty else level).select("cloud_id", "key")
    return stencil_blocks(feat, rows, depth, weights.shape[1], lambda k, x: x @ weights[k].T, kernel, stride, transposed=True, height=height)


def depthwise_blocks(feat: DataFrame, nodes: DataFrame, depth: int, weights: np.ndarray, kernel: str = "333", height: int = 3, stride: int = 1, nempty: bool = True) -> DataFrame:
    """``stencil.depthwise_conv`` by blocks."""
    return stencil_blocks(feat, rows_of(nodes, depth, stride, nempty), depth, weights.shape[1], lambda k, x: x * weights[k], kernel, stride, height=height)


def group_blocks(feat: DataFrame, nodes: DataFrame, depth: int, weights: list[np.ndarray], kernel: str = "333", height: int = 3, stride: int = 1, nempty: bool = True) -> DataFrame:
    """``stencil.group_conv`` by blocks: slices of the channels are multiplied each with its own weights."""
    ends = np.cumsum([w.shape[1] for w in weights])
    slices = [slice(end - w.shape[1], end) for end, w in zip(ends, weights)]
    product = lambda k, x: np.concatenate([x[:, s] @ w[k] for s, w in zip(slices, weights)], 1)
    return stencil_blocks(feat, _rows(nodes, depth, stride, nempty), depth, sum(w.shape[2] for w in weights), product, kernel, stride, keep=not nempty, height=height)
