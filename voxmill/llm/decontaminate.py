"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document as long as a benchmark item (in words) that could reach the similarity
gets a SimHash fingerprint over its five-word shingles. Item fingerprints are indexed by
eight byte blocks, each under all values within two bits, which finds every item within
23 bits; candidates are then compared exactly by the weighted Jaccard similarity of their
shingles (weights: how often a shingle occurs). Windows that share too few shingles with any item
of their size to reach the similarity are passed over first; this loses nothing. A document with fewer
shingles than the item is one window, all of it, compared exactly without a fingerprint.

Words are runs of letters, digits and other non-ASCII characters, A-Z in lower case. An item of
fewer than five words has one shingle, all its words; an item without words (or null) matches
nothing. Null texts match nothing. Items are handled in blocks of a bounded size, each
broadcast. Repeated rows yield one result in ``find_leaks`` and are all kept, or all dropped, by ``drop_leaks``. Long texts are read
whole; of windows of equal similarity the first counts. Other columns than id and text are not read, may have any names and come back as they
were; empty tables of documents give empty results, an empty benchmark drops nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import WordHashes, mix, rolling

WIDTH, SIMILAR = 5, 0.8
#: Bits of a fingerprint that may differ: (BLOCK_BITS + 1) * 8 - 1 with BLOCK_BITS in each byte.
BLOCK_BITS, RADIUS = 2, 23
#: Benchmark text in one broadcast, in bytes.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22

PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(PLAIN).split()


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    return rolling(ids, width)


def prefix_bits(hashes: np.ndarray) -> np.ndarray:
    """Running counts of the set bits, one column a bit, with a first row of zeros."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the runs of n shingles from each of ``first``."""
    return np.packbits(2 * (sums[first + n] - sums[first]) > n, axis=1).view(np.uint64).ravel()


def similarity(a: Counter, b: np.ndarray) -> float:
    other = Counter(b.tolist())
    both = sum((a & other).values())
    return both / (sum(a.values()) + len(b) - both)


class Index:
    """Items by size, by shingle and by fingerprint block."""

    def __init__(self, items: list[tuple], similar: float = SIMILAR) -> None:
        hashes = WordHashes()
        self.similar = similar
        self.groups: dict[int, Group] = {}
        by_width: dict[int, list] = {}
        for item, text in items:
            ids = hashes.array(plain_words(text))
            if len(ids):
                width = min(WIDTH, len(ids))
                by_width.setdefault(width, []).append((item, shingles(ids, width)))
        self.groups = {w: Group(w, x, similar) for w, x in by_width.items()}

    def search(self, text: str | None, hashes: WordHashes) -> list[tuple]:
        tokens = plain_words(text)
        if not tokens or not self.groups:
            return []
        ids = hashes.array(tokens)
        return [x for group in self.groups.values() for x in group.search(ids)]


class Group:
    """Items with shingles of one width."""

    def __init__(self, width: int, items: list[tuple], similar: float) -> None:
        self.width, self.similar = width, similar
        self.items = items
        self.sizes = np.array([len(s) for _, s in items])
        self.bags = [Counter(s.tolist()) for _, s in items]
        pairs = sorted({(h, k) for k, bag in enumerate(self.bags) for h in bag})
        self.shingle = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([k for _, k in pairs])
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[self.shingle >> np.uint64(64 - TABLE_BITS)] = True
        self.prints = np.array([fingerprints(prefix_bits(s), np.array([0]), len(s))[0] for _, s in items], np.uint64)
        near = [[v for v in range(256) if (v ^ b).bit_count() <= BLOCK_BITS] for b in range(256)]
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        self.block: list[list[list[int]]] = [[[] for _ in range(256)] for _ in range(8)]
        for k, row in enumerate(blocks):
            for j, b in enumerate(row):
                for v in near[b]:
                    self.block[j][v].append(k)

    def within(self, print_: np.uint64, n: int) -> list[int]:
        """Items of n shingles whose fingerprint is at most RADIUS bits away."""
        found = {k for j, b in enumerate(np.array([print_]).view(np.uint8)) for k in self.block[j][b]}
        return [k for k in sorted(found) if self.sizes[k] == n and int(self.prints[k] ^ print_).bit_count() <= RADIUS]

    def search(self, ids: np.ndarray) -> list[tuple]:
        """(item, first word, words, similarity) of the best window for each item reached."""
        h = shingles(ids, self.width)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - TABLE_BITS)])
        if not len(at):
            return []
        low, high = np.searchsorted(self.shingle, h[at], "left"), np.searchsorted(self.shingle, h[at], "right")
        spot = np.repeat(at, high - low)
        owner = self.owner[np.concatenate([np.arange(a, b) for a, b in zip(low, high)])] if len(spot) else spot
        hits = np.bincount(owner, minlength=len(self.items))
        need = np.ceil((self.sizes + np.minimum(self.sizes, len(h))) * self.similar / (1 + self.similar) - 1e-9).astype(np.int64)
        windows: dict[int, set[int]] = {}
        best: dict[int, tuple[float, int]] = {}
        for k in np.flatnonzero(hits >= need):
            n, places = int(self.sizes[k]), np.sort(spot[owner == k])
            if n > len(h):  # the whole document is the only window
                s = similarity(self.bags[k], h)
                if s >= self.similar:
                    best[k] = s, 0
                continue
            starts = np.unique(np.concatenate([np.arange(max(0, p - n + 1), min(p, len(h) - n) + 1) for p in places]))
            inside = np.searchsorted(places, starts + n) - np.searchsorted(places, starts)
            windows.setdefault(n, set()).update(starts[inside >= need[k]].tolist())
        for n, starts in windows.items():
            if not starts:
                continue
            first = np.array(sorted(starts))
            sums = prefix_bits(h[first[0] : first[-1] + n])
            for start, print_ in zip(first.tolist(), fingerprints(sums, first - first[0], n)):
                for k in self.within(print_, n):
                    s = similarity(self.bags[k], h[start : start + n])
                    if s >= self.similar and s > best.get(k, (0, 0))[0]:
                        best[k] = s, start
        return [(self.items[k][0], start, min(int(self.sizes[k]), len(h)) + self.width - 1, s) for k, (s, start) in sorted(best.items())]


def indexes(benchmark: DataFrame, similar: float = SIMILAR) -> Iterator[Index]:
    """One index for each block of items, BLOCK_BYTES of text at most on average."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Index([tuple(r) for r in block.collect()], similar)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of every item in every document."""
    ids = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = "doc_id string, item_id string, first_word bigint, n_words bigint, similarity double"
    context = docs.sparkSession.sparkContext
    found = []
    for index in indexes(benchmark, similar):
        shared = context.broadcast(index)

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for part in parts:
                out = [(doc, *x) for doc, text in zip(part["doc_id"], part["text"]) for x in shared.value.search(text, hashes)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found.append(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    return all_found.distinct().withColumns({n: F.col(n).cast(kind) for n, kind in ids.items()})


def leak_flag(shared: Broadcast) -> Callable[[F.Column], F.Column]:
    """A column function: does the text hold an item of the broadcast index?"""

    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in parts:
            yield pd.Series([bool(shared.value.search(x, hashes)) for x in texts], dtype=bool)

    leaks.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(leaks, "boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    context = docs.sparkSession.sparkContext
    for index in indexes(benchmark, similar):
        docs = docs.where(~leak_flag(context.broadcast(index))(F.col("text").cast("string")))
    return docs
