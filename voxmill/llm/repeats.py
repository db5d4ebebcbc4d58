"""Repeated passages found by fixed-block anchors.

A passage is ``WINDOW`` consecutive words. A copy is removed if the same words also start in a
document with a smaller id. The search has these steps, each of which loses nothing:

1. *Pruning.* Of every passage the smallest hash of its eight-word runs is sketched. A passage
   that two documents share leaves the same sketch in both, so stretches without a sketch seen in
   two documents are done with.
2. *Anchors.* In what is left, non-overlapping blocks of ``BLOCK`` words (at multiples of BLOCK)
   are the index, and every rolling window of BLOCK words probes it. As 2 * BLOCK - 1 is less than
   WINDOW, each shared passage holds a block of one document that the other's probes hit.
3. *Extension.* Around hits, passages are compared whole (by a hash of the blocks at their two ends,
   which cover all their words) and the smallest document of each is found. The words covered by a
   document's hit passages are its maximal repeats.

The tables of steps are dropped when later ones are written.

Words are hashed with 64 bits; every table is grouped by hash with partial sums, so a
passage that a third of all documents share costs one row for each. Hot hashes (at most a
thousand, those in over a thousandth of the rows) are joined by broadcast, the others by
shuffle.

Null text has no words. Rows with a null id neither lose words nor cause a loss. Rows with equal ids
count as one document: none removes the other's words. Long texts are read whole. Of documents that share a passage the one of the smallest id
keeps it; ties of ids are as above. Other columns than the id and the text are not read and may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Steps, WordHashes, join_hot, mix, rolling, words

WINDOW, BLOCK, RUN = 50, 25, 8
#: The last block of a passage starts so many words after its first; together they are the passage.
FAR = WINDOW - BLOCK


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours."""
    if len(x) < n:
        return x[:0]
    padded = np.full(-(-len(x) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(x) - n + 1], left[n - 1 : len(x)])


def covered(marks: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``length`` places lie in [m, m + n) for a mark m."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, np.maximum(marks, 0), 1)
    np.add.at(edge, np.minimum(marks + n, length), -1)
    return np.cumsum(edge[:-1]) > 0


def sketch(ids: np.ndarray) -> np.ndarray:
    return np.unique(sliding_min(rolling(ids, RUN), WINDOW - RUN + 1))


def passages(blocks: np.ndarray) -> np.ndarray:
    """Hashes of passages from those of the blocks in which they start and end."""
    return mix(mix(blocks[: max(len(blocks) - FAR, 0)]) + blocks[FAR:])


def stretches(ids: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, hashes of blocks) of runs of passages with a shared sketch."""
    if len(ids) < WINDOW:
        return
    inside = np.isin(sliding_min(rolling(ids, RUN), WINDOW - RUN + 1), shared)
    if not inside.any():
        return
    blocks = rolling(ids, BLOCK)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        yield int(a), blocks[a : b + FAR]


def with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).cast("string").alias("content"))


def removed_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``passages``, the hashes of the passages that each document loses."""
    rows = with_words(docs, text).where(F.col("doc_id").isNotNull() & F.col("content").isNotNull())

    kind = docs.schema["doc_id"].dataType
    named = rows.select(F.col("doc_id").cast("string"), "content")  # ids travel as text: pandas has no long beside null

    def lists(found: list) -> pd.Series:
        return pd.Series(found, dtype=object)

    def sketches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            found = [sketch(hashes.array(words(t))).view(np.int64) for t in part["content"]]
            some = [k for k, x in enumerate(found) if len(x)]
            yield pd.DataFrame({"doc_id": lists([part["doc_id"].iloc[k] for k in some]), "sketch": lists([found[k] for k in some])})

    def regions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            out = []
            for doc, t, shared in zip(part["doc_id"], part["content"], part["shared"]):
                ids = hashes.array(words(t))
                out += [(doc, a, b.view(np.int64)) for a, b in stretches(ids, np.asarray(shared, np.int64).view(np.uint64))]
            yield pd.DataFrame({n: lists([x[k] for x in out]) for k, n in enumerate(("doc_id", "first_word", "blocks"))})

    def extend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept = []
            for blocks, hits in zip(part["blocks"], part["hits"]):
                p = passages(np.asarray(blocks, np.int64).view(np.uint64)).view(np.int64)
                # a hit block at k lies in the passages that start at k - FAR .. k
                marks = np.asarray(hits, np.int64) - FAR
                inside = np.zeros(len(p) + 1, np.int64)
                np.add.at(inside, np.clip(marks, 0, len(p)), 1)
                np.add.at(inside, np.clip(marks + FAR + 1, 0, len(p)), -1)
                kept.append(np.unique(p[np.cumsum(inside[:-1]) > 0]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "passages": lists(kept)})

    steps = Steps(docs.sparkSession)
    own = lambda df: df.withColumn("doc_id", F.col("doc_id").cast(kind))
    by_run = steps.write("sketches", own(named.mapInPandas(sketches, "doc_id string, sketch array<bigint>"))).select("doc_id", F.explode("sketch").alias("h"))
    shared = steps.write("shared", by_run.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n"))
    told = steps.write("told", join_hot(by_run, shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")))
    steps.drop("sketches", "shared")
    found = own(rows.join(told, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(regions, "doc_id string, first_word int, blocks array<bigint>"))
    left = steps.write("stretches", found.withColumn("row", F.monotonically_increasing_id()))
    steps.drop("told")
    probes = left.select("row", "doc_id", "first_word", F.posexplode("blocks").alias("at", "h"))
    indexed = F.when((F.col("first_word") + F.col("at")) % BLOCK == 0, F.col("doc_id"))
    anchors = steps.write("anchors", probes.groupBy("h").agg(F.min(indexed).alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n"))
    hits = steps.write("hits", join_hot(probes.select("row", "at", "h"), anchors, "h").groupBy("row").agg(F.collect_set("at").alias("hits")))
    near = left.select("row", "doc_id", "blocks").join(hits, "row").select(F.col("doc_id").cast("string"), "blocks", "hits")
    near = steps.write("extended", own(near.mapInPandas(extend, "doc_id string, passages array<bigint>"))).select("doc_id", F.explode("passages").alias("h"))
    steps.drop("stretches", "anchors", "hits")
    firsts = steps.write("firsts", near.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "lo", "n"))
    lost = join_hot(near, firsts, "h").where("lo < doc_id")
    lost = steps.write("lost", lost.groupBy("doc_id").agg(F.collect_set("h").alias("passages")))
    steps.drop("extended", "firsts")
    return lost


def kept_words(tokens: list[bytes], lost: np.ndarray, hashes: WordHashes) -> list[bytes]:
    found = np.flatnonzero(np.isin(passages(rolling(hashes.array(tokens), BLOCK)), lost))
    gone = covered(found, WINDOW, len(tokens))
    return [t for t, g in zip(tokens, gone) if not g]


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, by single spaces)."""
    lost = removed_passages(docs, text)

    kind = docs.schema["doc_id"].dataType

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            out = []
            for doc, t, gone in zip(part["doc_id"], part["content"], part["passages"]):
                tokens = words(t)
                left = tokens if gone is None else kept_words(tokens, np.asarray(gone, np.int64).view(np.uint64), hashes)
                kept = b" ".join(left)
                out.append((doc, len(tokens), len(tokens) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    named = with_words(docs, text).join(lost, "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    done = named.mapInPandas(run, "doc_id string, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
