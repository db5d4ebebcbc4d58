"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt by hash into blocks of about ``BLOCK`` rows. A block holds for each dimension the list of its rows in order
of that component. Anchors read the lists from the end that their component's sign says (sorted access), so that what a
component adds to the score falls along each list; rows met are scored by integers (random access). The threshold is the score of a row
that would stand in all lists at once where reading has come to: no row unread has a higher one. Reading stops once the threshold
is strictly below each window's k-th best score, or below all scores that the windows take.

An anchor's positives are the best rows of its own label, found first, by the lists of that label's rows; each positive's
score sets a window of scores, and the best rows of other labels inside it are its negatives. Every group of anchors meets every block, as
exact search must; the best of a block (k for each anchor or window) are put together by Spark. Task sizes depend on ``BLOCK``
and ``GROUP`` alone, and no label, vector or score that many rows share goes to one task: rows are dealt by the hash of all
columns, after equal rows have become one with a count.

Rows with a null id, label, vector or component, or a component that is not finite, take no part; vectors of different length are filled up with zeros; components
are cut to 2^28 in size, so that scores are exact longs. Ties go to the smaller id. Equal rows count as often as they are there: as
anchors, positives and negatives. An empty table gives an empty result. Other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.llm.common import Steps

#: Rows of a block and anchors of a group, about.
BLOCK, GROUP = 8192, 1024
#: Entries of each list that the first round reads; each round reads as many as all before it.
FIRST = 16
LARGEST = 1 << 28


class Lists:
    """Rows of a block (ids in rising order) with, for each dimension, their order by that component."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.rounded, self.most = vectors.astype(np.float64), int(np.abs(vectors).max(initial=0))

    def best(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, score) of the ``k`` best of the ``allowed`` rows with low <= score <= high for each window; ties by row."""
        n = len(self.vectors)
        read = np.flatnonzero(anchor)
        up = anchor[read] < 0  # these components are best where the row's is smallest
        # products of doubles are exact, and faster, while sums stay below 2^53
        exact = self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53
        held, by = (self.rounded, anchor.astype(np.float64)) if exact else (self.vectors, anchor)
        seen = np.zeros(n, bool) if allowed is None else ~allowed
        rows, scores, depth = [], [], 0
        while depth < n:
            upto = min(n, max(FIRST, 2 * depth)) if len(read) else n
            hit = np.zeros(n, bool)
            hit[self.order[depth:upto, read[up]]] = True
            hit[self.order[n - upto : n - depth, read[~up]]] = True
            met = np.flatnonzero(hit & ~seen) if len(read) else np.flatnonzero(~seen)
            seen[met] = True
            rows.append(met)
            scores.append((held[met] @ by).astype(np.int64))
            depth = upto
            if depth < n:
                edge = np.where(up, self.vectors[self.order[depth - 1, read], read], self.vectors[self.order[n - depth, read], read])
                threshold, found = int(edge @ anchor[read]), np.concatenate(scores)
                if all(threshold < low or np.count_nonzero((found > threshold) & (found >= low) & (found <= high)) >= k for low, high in windows):
                    break  # nothing unread can be among the best of any window
        rows, scores = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*scores, np.empty(0, np.int64)])
        out = [np.empty((3, 0), np.int64)]
        for w, (low, high) in enumerate(windows):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            top = inside[np.lexsort((rows[inside], -scores[inside]))[:k]]
            out.append(np.stack([np.full(len(top), w), rows[top], scores[top]]))
        return tuple(np.concatenate(out, 1))


def whole(vector: str) -> Column:
    """Components times 256, rounded down, as whole numbers of at most LARGEST in size."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for size in np.unique(sizes := np.diff(np.asarray(column.offsets))):
        at = np.flatnonzero(sizes == size)
        out[at, :size] = np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), size)
    return out


def nearest(blocks: DataFrame, anchors: DataFrame, width: int, k: int, share: tuple[int, int, int] | None = None) -> DataFrame:
    """The ``k`` best rows of each anchor's windows in each block: a_id, a_label, a_vector, window, id, label, n, score.

    ``blocks``: grp, block, id, label, vector, n. ``anchors``: grp, block, a_id, a_label, a_vector, scores. Without ``share`` rows are those of the
    anchor's own label, all in window 0, one copy of the anchor itself left out; else those of all other labels, with a window for each of ``scores``.
    """
    schema = "a_id bigint, a_label bigint, a_vector array<int>, window int, id bigint, label bigint, n bigint, score bigint"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.schema([("a_id", pa.int64()), ("a_label", pa.int64()), ("a_vector", pa.list_(pa.int32())), ("window", pa.int32()), *[(c, pa.int64()) for c in ("id", "label", "n", "score")]]).empty_table()
        left = left.sort_by("id")
        rows = {c: left[c].combine_chunks() for c in ("id", "label", "vector", "n")}
        asks = {c: right[c].combine_chunks() for c in ("a_id", "a_label", "a_vector", "scores")}
        out = [np.empty((5, 0), np.int64)]  # anchor, window, row, score, copies
        vectors, wanted = matrix(rows["vector"], width), matrix(asks["a_vector"], width)
        label, a_label, ids, a_ids, copies = (np.asarray(x) for x in (rows["label"], asks["a_label"], rows["id"], asks["a_id"], rows["n"]))
        lists = Lists(vectors) if share else None
        for one in np.unique(a_label):
            own = np.flatnonzero(label == one)
            if not share:
                lists = Lists(vectors[own])
            for at in np.flatnonzero(a_label == one):
                if share:
                    windows = [(-(-p * share[0] // share[1]), p * share[2] // share[1]) for p in asks["scores"][int(at)].as_py()]
                    window, row, score = lists.best(wanted[at], windows, k, label != one)
                    n = copies[row]
                else:
                    window, row, score = lists.best(wanted[at], [(-(1 << 62), 1 << 62)], k + 1)
                    row = own[row]
                    n = copies[row] - ((ids[row] == a_ids[at]) & (vectors[row] == wanted[at]).all(1))
                out.append(np.stack([np.full(len(row), at), window, row, score, n])[:, n > 0])
        at, window, row, score, n = np.concatenate(out, 1)
        columns = [asks[c].take(pa.array(at)) for c in ("a_id", "a_label", "a_vector")] + [pa.array(window.astype(np.int32))]
        columns += [rows[c].take(pa.array(row)) for c in ("id", "label")] + [pa.array(n), pa.array(score)]
        return pa.Table.from_arrays(columns, ["a_id", "a_label", "a_vector", "window", "id", "label", "n", "score"])

    return blocks.groupBy("grp", "block").cogroup(anchors.groupBy("grp", "block")).applyInArrow(run, schema)


def ranked_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of ``found`` in each group, rows with n copies as n rows, with ``rank`` from 1."""
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("copy", "n")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int, int] = (50, 100, 95)) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, embedding, label): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score s satisfies share[0] * p <= share[1] * s <= share[2] * p for the positive's score p. ``is_anchor`` is
    a condition on the columns of ``rows``.
    """
    spark, steps = rows.sparkSession, Steps(rows.sparkSession)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    kept = kept.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole("embedding").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    # equal rows become one with a count
    kept = steps.write("rows", kept.groupBy("id", "label", "vector", "asks").agg(F.count("*").alias("n")))
    size, asking, width = kept.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_blocks, n_groups = max(1, -(-size // BLOCK)), max(1, -(-asking // GROUP))
    block, grp = (F.pmod(F.xxhash64("id", "label", "vector", F.lit(k)), F.lit(n)).cast("long") for k, n in ((0, n_blocks), (1, n_groups)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = kept.select("id", "label", "vector", "n", block.alias("block"), numbers(n_groups).alias("grp"))
    anchors = kept.where("asks").select(F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("vector").alias("a_vector"), F.col("n").alias("a_n"), grp.alias("grp"))
    anchors = steps.write("anchors", anchors)
    asked = anchors.select("*", numbers(n_blocks).alias("block"), F.array().cast("array<bigint>").alias("scores"))
    key = ["a_id", "a_label", "a_vector"]
    found = steps.write("found", nearest(dealt, asked, width, positives))
    best = steps.write("positives", ranked_rows(found, key, positives))
    # windows: one for each distinct score of an anchor's positives
    windows = best.groupBy(*key).agg(F.array_sort(F.collect_set("score")).alias("scores"))  # at most ``positives`` of them
    asked = anchors.join(windows, key).select("*", numbers(n_blocks).alias("block"))
    near = ranked_rows(steps.write("near", nearest(dealt, asked, width, negatives, share)), [*key, "window"], negatives)
    told = best.join(windows, key).withColumn("window", (F.array_position("scores", F.col("score")) - 1).cast("int"))
    told = told.select(*key, "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = told.join(near.select(*key, "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), [*key, "window"]).join(anchors.select(*key, "a_n"), key)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("a_n"))))
    return out.select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
