"""Links between the tokens of two tokenizers over the same texts.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (sentence pieces) the text, to which it adds the
space. Each gives an incidence matrix of tokens and bytes in compressed rows (``Csr``). The product A B^T, made row by
row (Gustavson), has the bytes that two tokens share: overlap links. Offsets where tokens of both end cut the text
into groups; the product of the two group incidences has the pairs of a group: shared-group links. Overlap
links whose ends are the same offset are *end links*, which are counted over the corpus by id pair.

Texts without double, leading or trailing spaces are products of blocks, one for each word with its space, as no token
crosses a space; so words' products are remembered (``WORDS`` at most) and a text puts them together. Other texts are one
block, cut at common ends so that a product never has more than about ``SPAN`` bytes at once.

Counts of id pairs are summed in tasks, then by a shuffle. Pairs with more than a 2^-17 of all links (so at
most 2^17 pairs, 2 MB) are broadcast; for the rest the documents' distinct pairs are joined by shuffle, where no pair is hot.

Null and empty texts, and those whose tokens do not give back the text's bytes, have no tokens: zeros and ''. Repeated rows and
null ids come back as they are; long texts count whole; an empty table gives an empty result. Other columns than the id and
the text are not read and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import Steps
from voxmill.llm.vocab import LONG_WORD, UNCUT, ByteLevel, Pieces

#: Words that a task remembers, at most.
WORDS = 400_000
#: Bytes in one product, about.
SPAN = 1 << 20
#: Characters of text that are worked on at once.
SLICE = 4 << 20
#: Pairs with more than this share of all links are met by broadcast.
HOT_SHARE = 2.0**-17
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix in compressed rows: row r has ``indices[starts[r]:starts[r + 1]]`` with the same part of ``data``."""

    starts: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def csr(rows: np.ndarray, cols: np.ndarray, data: np.ndarray, height: int, width: int) -> Csr:
    """From entries in any order; equal places are summed."""
    place = rows * width + cols
    if len(place) and (np.diff(place) < 0).any():
        order = np.argsort(place, kind="stable")
        place, data = place[order], data[order]
    first = np.flatnonzero(np.r_[True, np.diff(place) != 0][: len(place)])
    data = np.add.reduceat(data, first) if len(first) else data[:0]
    rows, cols = place[first] // max(width, 1), place[first] % max(width, 1)
    return Csr(np.r_[0, np.cumsum(np.bincount(rows, minlength=height))], cols, data, width)


def transpose(m: Csr) -> Csr:
    return csr(m.indices, m.rows(), m.data, m.width, len(m.starts) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson: a row of the product is the sum of the rows of ``b`` that the row of ``a`` names, each times its entry."""
    sizes = np.diff(b.starts)[a.indices]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.starts[a.indices] - (ends - sizes), sizes)
    return csr(np.repeat(a.rows(), sizes), b.indices[at], np.repeat(a.data, sizes) * b.data[at], len(a.starts) - 1, b.width)


def token_bytes(ends: np.ndarray, start: int) -> Csr:
    """Incidence of tokens, which end at these offsets one after another, and the bytes from ``start`` on."""
    starts = np.r_[0, ends - start]
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def group_members(groups: np.ndarray, n_groups: int) -> Csr:
    """Incidence of tokens and their groups."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n_groups)


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> dict[str, np.ndarray]:
    """Links of tokens of two sides that end at these byte offsets (both sides to the same last one).

    ``groups``: the common ends; ``a``, ``b``, ``shared_bytes``: overlap links; ``ga``, ``gb``: shared-group links.
    """
    groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
    last = groups[-1] if len(groups) else 0
    cuts = np.unique(np.r_[groups[np.minimum(np.searchsorted(groups, np.arange(SPAN, last, SPAN)), len(groups) - 1)], last]) if last else []
    parts, start = [], 0
    for end in cuts:
        i, j, g = (np.searchsorted(x, [start, end], "right") for x in (ends_a, ends_b, groups))
        a, b, own = ends_a[i[0] : i[1]], ends_b[j[0] : j[1]], groups[g[0] : g[1]]
        overlap = product(token_bytes(a, start), transpose(token_bytes(b, start)))
        shared = product(group_members(np.searchsorted(own, a), len(own)), transpose(group_members(np.searchsorted(own, b), len(own))))
        parts.append((overlap.rows() + i[0], overlap.indices + j[0], overlap.data, shared.rows() + i[0], shared.indices + j[0]))
        start = end
    names = ("a", "b", "shared_bytes", "ga", "gb")
    return {"groups": groups} | {n: np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k, n in enumerate(names)}


class Aligner:
    """Aligns texts by blocks; see the module's text."""

    def __init__(self, a_path: str, b_path: str, limit: int = WORDS) -> None:
        self.a, self.b, self.limit = ByteLevel(a_path, plain=True), Pieces(b_path), limit
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side.pieces], np.int64) for side in (self.a, self.b))
        self.names = [np.array([f"{i}{end}" for end in ends for i in range(n)], object) for ends, n in ((",|", len(self.sizes_a)), (",;", len(self.sizes_b)))]
        self.forget()

    def forget(self) -> None:
        """Entry 0 stands for a block whose tokens do not give back its bytes."""
        self.known: dict[str, int] = {}
        self.texts, self.pairs, self.counts = [""], [b""], [np.full((1, len(COUNTS)), -1, np.int64)]

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; a unit that does not come out as its bytes has none."""
        ids_a = [self.a.word_ids(" " + x) for x in units]
        ids_b = self.b.ids(units)
        for k, x in enumerate(units):
            want = (" " + x).encode()
            if b"".join(map(self.a.pieces.__getitem__, ids_a[k])) != want or b"".join(map(self.b.pieces.__getitem__, ids_b[k])) != want:
                ids_a[k] = ids_b[k] = []
        return ids_a, ids_b

    def add(self, units: list[str]) -> None:
        """Work out the blocks of these units and remember them."""
        ids_a, ids_b = self.tokens(units)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        all_a, all_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[all_a]), np.cumsum(self.sizes_b[all_b])
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        met = linked(ends_a, ends_b)
        closing = ends_a[met["a"]] == ends_b[met["b"]]
        link_a, link_b = met["a"][closing], met["b"][closing]
        count = lambda at: np.bincount(unit_a[at], minlength=len(units))
        group_at = np.searchsorted(ends_a, met["groups"])  # the token of A that ends a group
        counts = np.stack([n_a, n_b, count(group_at), count(link_a), count(met["a"]), count(met["ga"])], 1)
        counts[n_a == 0] = -1
        # the text of the groups: tokens of A, then those of B, group by group
        closes_a, closes_b = np.isin(ends_a, met["groups"]), np.isin(ends_b, met["groups"])
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        before_b = np.r_[0, np.cumsum(np.bincount(group_b))] if len(group_b) else np.zeros(1, np.int64)
        upto_a = np.cumsum(np.bincount(group_a)) if len(group_a) else np.zeros(1, np.int64)
        said = np.empty(len(all_a) + len(all_b), object)
        said[np.arange(len(all_a)) + before_b[group_a]] = self.names[0][all_a + closes_a * len(self.sizes_a)]
        said[np.arange(len(all_b)) + upto_a[group_b]] = self.names[1][all_b + closes_b * len(self.sizes_b)]
        pairs = all_a[link_a] * len(self.sizes_b) + all_b[link_b]
        said, cut = said.tolist(), np.r_[0, np.cumsum(n_a + n_b)].tolist()
        link_cut = np.r_[0, np.cumsum(count(link_a))].tolist()
        first = len(self.texts)
        self.texts += ["".join(said[i:j])[:-1] for i, j in zip(cut, cut[1:])]
        self.pairs += [pairs[i:j].astype("<i8").tobytes() for i, j in zip(link_cut, link_cut[1:])]
        self.counts.append(counts)
        self.known.update(zip(units, range(first, first + len(units))))

    def units(self, text: str) -> list[str]:
        if not self.b.by_word or self.a.fast is None or "  " in text or text[0] == " " or text[-1] == " " or UNCUT.search(text):
            return [text]
        return text.split(" ")

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """For each text COUNTS, the text of its groups, and the id pairs of its end links in order."""
        cut = [self.units(x) if x else [] for x in texts]
        new = {u for units in cut for u in units} - self.known.keys()
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = {u for units in cut for u in units}
        if new:
            self.add(list(new))
        counts = np.concatenate(self.counts)
        self.counts = [counts]
        for units in cut:
            at = list(map(self.known.__getitem__, units))
            total = counts[at]
            if not at or (total[:, 0] < 0).any():
                yield np.zeros(len(COUNTS), np.int64), "", np.empty(0, np.int64)
            else:
                yield total.sum(0), ";".join(map(self.texts.__getitem__, at)), np.frombuffer(b"".join(map(self.pairs.__getitem__, at)), "<i8")
        for u in new:
            if len(u) > LONG_WORD:  # used once, then let go
                at = self.known.pop(u)
                self.texts[at], self.pairs[at] = "", b""


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows that hold about SLICE characters."""
    first, run, size = 0, [], 0
    for k, x in enumerate(texts):
        run.append(x.as_py() or "")
        size += len(run[-1])
        if size >= SLICE or k == len(texts) - 1:
            yield first, run
            first, run, size = k + 1, [], 0


def flat(lists: list[np.ndarray], kind: str) -> pa.ListArray:
    """One list a row."""
    values = np.concatenate([*lists, np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)), pa.array(values.astype(np.int32 if kind == "int" else np.int64)))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, np.diff(keys) != 0][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def token_links(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Every overlap link: doc_id, a_at, a_id, b_at, b_id (positions from 0 and ids), n_bytes shared, group, and whether both end together."""
    schema = "doc_id {}, a_at bigint, a_id int, b_at bigint, b_id int, n_bytes bigint, `group` bigint, ends_together boolean".format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for k, x in enumerate(batch.column(1)):
                ids_a, ids_b = (np.array(x[0], np.int64) for x in own.tokens([x.as_py()])) if x.as_py() else (np.empty(0, np.int64),) * 2
                ends_a, ends_b = np.cumsum(own.sizes_a[ids_a]), np.cumsum(own.sizes_b[ids_b])
                met = linked(ends_a, ends_b)
                a, b = met["a"], met["b"]
                group = np.searchsorted(met["groups"], ends_a[a])
                columns = [pa.array(a), pa.array(ids_a[a].astype(np.int32)), pa.array(b), pa.array(ids_b[b].astype(np.int32)), pa.array(met["shared_bytes"]), pa.array(group), pa.array(ends_a[a] == ends_b[b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(a), k))), *columns], ["doc_id", "a_at", "a_id", "b_at", "b_id", "n_bytes", "group", "ends_together"])

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Per document doc_id, n_a and n_b (tokens), n_groups, n_links (end links), n_best (those whose pair is the most common one
    of its B id in the corpus, ties included), count_sum (of their pairs' counts), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``), n_overlaps and n_shared.
    """
    spark, steps = docs.sparkSession, Steps(docs.sparkSession)
    size_b = len(Pieces(b_path).pieces)
    kind = "int" if len(ByteLevel(a_path, plain=True).pieces) * size_b < 1 << 31 else "bigint"
    small = ", ".join(f"{c} bigint" for c in COUNTS)
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                counts, digests, pairs, times = [], [], [], []
                for total, groups, links in own.align(texts):
                    counts.append(total)
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    keys, n = summed(links, np.ones(len(links), np.int64))
                    pairs.append(keys)
                    times.append(n)
                table = np.stack(counts, 1)
                kept = [batch.column(k).slice(first, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x) for x in table], pa.array(digests), flat(pairs, kind), flat(times, "int")], ["row", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).cast("string").alias("text"))
    told = steps.write("aligned", rows.mapInArrow(run, f"row bigint, doc_id {id_kind}, {small}, groups_sha256 string, pairs array<{kind}>, times array<int>"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), []
        out = lambda pairs, n: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        for batch in batches:
            waiting.append(tuple(np.asarray(batch.column(k).flatten()).astype(np.int64) for k in (0, 1)))
            if sum(len(x) for x, _ in waiting) > max(1 << 20, len(held[0])):
                held, waiting = summed(*(np.concatenate(x) for x in zip(held, *waiting))), []
            if len(held[0]) > 1 << 22:
                yield out(*held)
                held = (held[0][:0], held[1][:0])
        yield out(*summed(*(np.concatenate(x) for x in zip(held, *waiting))))

    counts = told.select("pairs", "times").mapInArrow(tally, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = steps.write("counts", counts)
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids
    counts = counts.join(F.broadcast(most), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") > total * HOT_SHARE).toArrow()
    order = np.argsort(np.asarray(hot["pair"]))
    hot_pair, hot_n, hot_best = (np.asarray(hot[c])[order].astype(np.int64) for c in ("pair", "n", "best"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            row = np.repeat(np.asarray(batch.column(0)), sizes)
            pairs, times = (np.asarray(batch.column(k).flatten()).astype(np.int64) for k in (1, 2))
            if not len(pairs):
                continue
            spot = np.minimum(np.searchsorted(hot_pair, pairs), max(len(hot_pair) - 1, 0))
            is_hot = hot_pair[spot] == pairs if len(hot_pair) else np.zeros(len(pairs), bool)
            at = np.repeat(np.arange(len(sizes)), sizes)[is_hot]
            add = lambda v: np.bincount(at, v[spot[is_hot]] * times[is_hot], len(sizes)).astype(np.int64) if len(at) else np.zeros(len(sizes), np.int64)
            some = [np.asarray(batch.column(0)), np.full(len(sizes), -1), add(hot_n), add(hot_best)]
            rest = [row[~is_hot], pairs[~is_hot], times[~is_hot], np.zeros((~is_hot).sum(), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y]).astype(np.int64)) for x, y in zip(some, rest)], ["row", "pair", "x", "n_best"])

    met = steps.write("met", told.select("row", "pairs", "times").mapInArrow(meet, "row bigint, pair bigint, x bigint, n_best bigint"))
    cold = met.where("pair >= 0").join(counts.where(F.col("n") <= total * HOT_SHARE), "pair")
    cold = cold.select("row", (F.col("x") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("x")).otherwise(0).alias("n_best"))
    sums = met.where("pair < 0").select("row", F.col("x").alias("count_sum"), "n_best").unionByName(cold).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = told.drop("pairs", "times").join(sums, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_overlaps", "n_shared")
