"""Near-duplicates of five-word similarity 0.8, with those of SimHash.

Links are those of ``simhash`` (fingerprints of three-word shingles within 3 bits, near-duplicates by
that operator's definition) and more: texts whose five-word shingle sets have a Jaccard similarity of at least 0.8.
Unrelated fingerprints are 32 bits apart with a spread of 4, so triangle bounds cut nothing at the radius that these
need. Their candidates are therefore texts that agree in one of ``BANDS`` bands of ``ROWS`` minima of the set: at 0.8 a pair is
missed with a chance of 3 in a million, at 0.3 one pair in 13 is looked at. Bands of equal members are one; what they hold
is compared by sketches of 256 one-byte minima, whose spread at 0.8 is 0.025: ``LOOSE`` lies four spreads below.

In groups too large for one task, blocks meet themselves and their neighbours first; only what is not joined up by that meets the whole group.

Only spanning candidates are put out. What they connect is a cluster, and every similar pair lies in one; inside
the clusters candidates are compared by their exact sets, unless they are joined up already.
Null and empty texts are one group (their fingerprint is zero); rows with a null id are always kept.
Of texts with equal fingerprints that of the smallest id stands for all. Repeated rows come back from ``groups`` as often as they
came in; long texts are read whole; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.llm.common import WordHashes, by_row, grams, join_hot, lower_words, mix, signed, staged
from voxmill.llm.simhash import Links, components, fingerprint, near_links

SHINGLE, BINS, LOOSE = 5, 256, 0.7
#: Two sets of similarity s share a band with a chance of 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 32, 5
#: Nodes that are compared in one task; larger groups go by pairs of blocks.
BLOCK = 2048
#: Where a row is compared: its group, the group's home (many small groups share one) and blocks, its own block, those it meets, and what it is known to be linked to.
PLACED = ("fp", "key", "home", "blocks", "block", "low", "high", "label")
_MINIMA = np.random.default_rng(11).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the five-word shingles."""
    ids = hashes.array(lower_words(text))
    return np.unique(grams(ids, min(SHINGLE, len(ids))) if len(ids) else ids)


def sketch(h: np.ndarray) -> bytes:
    """One byte for each bin of a shingle set: 0 if empty, else 1 to 255 of its smallest hash."""
    out = np.zeros(BINS, np.uint8)
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.append(True, np.diff(bins) != 0) if len(h) else np.empty(0, bool)  # h is sorted: a bin's first is its smallest
    out[bins[first]] = 1 + (mix(h[first]) % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the band's number and of the smallest values of ``h`` under its hash functions."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1024):
        np.minimum(least, (h[None, k : k + 1024] * _MINIMA).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys + row)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fp, sketch and band keys of every row."""

    def make() -> Callable[[str | None], tuple]:
        hashes = WordHashes()

        def one(text: str | None) -> tuple:
            h = shingle_set(text, hashes)
            return signed(fingerprint(text)), sketch(h), band_keys(h)

        return one

    made = by_row(make, "fp bigint, sketch binary, bands array<bigint>")(F.col("text").cast("string"))
    return docs.select("doc_id", made.alias("__made")).select("doc_id", "__made.*")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    return ((a == b) & (a > 0)).sum(1) / np.maximum(((a > 0) | (b > 0)).sum(1), 1)


def place(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``rows`` (fp, key) with what ``PLACED`` names: small groups share a home, large ones are cut into blocks that meet themselves and their neighbours."""
    homes = max(1, math.ceil(total / BLOCK))
    blocks = F.ceil(F.col("members") / BLOCK)
    home, block = F.when(blocks > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(homes))), F.pmod(F.xxhash64("fp"), blocks)
    sized = join_hot(rows, counts.withColumn("members", F.col("n")), "key")
    low, high = F.greatest(block - 1, F.lit(0).cast("bigint")), F.least(block + 1, blocks - 1)
    return sized.select("fp", "key", home.alias("home"), blocks.alias("blocks"), block.alias("block"), low.alias("low"), high.alias("high"), F.col("fp").alias("label"))


def apart(hot: DataFrame, links: DataFrame) -> DataFrame:
    """What ``links`` leave open in the groups ``hot`` (fp, key), placed anew.

    A group's largest component needs no more comparisons inside. The rows outside of it come in blocks from 0, which meet all blocks of
    the group; its own rows come in the blocks after, which meet those alone. Groups that are one component are gone.
    """
    labels = components(links)
    told = hot.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("label", "fp").alias("label"))
    told = staged(told, "told")
    sizes = told.groupBy("key", "label").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"))
    tops = staged(tops.where("n > most").withColumn("members", F.col("n")), "tops")
    outer, inner = F.ceil((F.col("members") - F.col("most")) / BLOCK), F.ceil(F.col("most") / BLOCK)
    at, inside = F.xxhash64("fp"), F.col("label") == F.col("top")
    block = F.when(inside, outer + F.pmod(at, inner)).otherwise(F.pmod(at, outer))
    high = F.when(inside, outer - 1).otherwise(outer + inner - 1)
    return join_hot(told, tops, "key").select("fp", "key", F.col("key").alias("home"), (outer + inner).alias("blocks"), block.alias("block"), F.lit(0).cast("bigint").alias("low"), high.alias("high"), "label")


def linked(valued: DataFrame, make: Callable[[pd.Series], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Spanning links (a, b) between the rows (``PLACED`` and a ``value``) of equal key whose blocks meet; rows of equal label count as linked.

    ``make`` takes the values of some rows and returns what tells which pairs of their positions are linked.
    """

    def link(part: pd.DataFrame) -> pd.DataFrame:
        across = part["i"].iat[0] != part["j"].iat[0]
        part = part.sort_values(["key", "block", "fp"])
        points, first, node = np.unique(part["fp"].to_numpy(np.int64), return_index=True, return_inverse=True)
        key, block = part["key"].to_numpy(np.int64), part["block"].to_numpy(np.int64)
        _, least, label = np.unique(part["label"].to_numpy(np.int64)[first], return_index=True, return_inverse=True)
        similar, links, start = make(part["value"].iloc[first]), Links(len(points)), least[label]
        links.parent = start.copy()
        at, step = np.arange(len(part)), 1
        while len(at := at[at + step < len(part)]) and len(at := at[key[at] == key[at + step]]):
            pairs = at[block[at] != block[at + step]] if across else at
            a, b = node[pairs], node[pairs + step]
            open_ = links.parent[a] != links.parent[b]  # joined up already: nothing to add
            a, b = a[open_], b[open_]
            if len(a):
                near = similar(a, b)
                links.add(a[near], b[near])
            step += 1
        moved = np.flatnonzero((links.parent != start) & (start == np.arange(len(points))))
        return pd.DataFrame({"a": points[moved], "b": points[links.parent[moved]]})

    dealt = valued.select("*", F.explode(F.sequence("low", "high")).alias("other"))
    dealt = dealt.select("fp", "key", "home", "blocks", "block", "label", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.groupBy("home", "blocks", "i", "j").applyInPandas(link, "a bigint, b bigint")


def compared(rows: DataFrame, counts: DataFrame, total: int, fetch: Callable[[DataFrame], DataFrame], make: Callable[[pd.Series], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Spanning links (a, b) of ``rows`` (fp, key; ``counts`` has the n of each key) among all pairs of equal key.

    ``fetch`` adds the values. Groups of three blocks and more are compared in two steps: blocks with themselves and their neighbours, then
    what that left apart with all of the group. A group of copies is joined up by the first, so its work does not grow with its square.
    """
    near = linked(fetch(place(rows, counts, total)), make)
    large = counts.where(F.col("n") > 2 * BLOCK)
    if large.isEmpty():
        return near
    near = staged(near, "near")
    hot = join_hot(rows, large, "key")
    return near.union(linked(fetch(apart(hot, near)), make))


def by_sketch(values: pd.Series) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Pairs with an estimated similarity of ``LOOSE``."""
    held = np.frombuffer(b"".join(values), np.uint8).reshape(-1, BINS)

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pieces = [alike(held[a[n : n + 4096]], held[b[n : n + 4096]]) >= LOOSE for n in range(0, len(a), 4096)]
        return np.concatenate(pieces)

    return similar


def by_set(values: pd.Series) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Pairs with an exact similarity of 0.8."""
    sets = [np.frombuffer(x, np.uint64) for x in values]
    loose = by_sketch(pd.Series(list(map(sketch, sets))))

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = loose(a, b)
        for n in np.flatnonzero(near):
            x, y = sets[a[n]], sets[b[n]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            near[n] = 5 * both >= 4 * (len(x) + len(y) - both)
        return near

    return similar


def similar_links(nodes: DataFrame) -> DataFrame:
    """Spanning candidates (a, b) between ``fp`` values of nodes (fp, sketch, bands)."""
    keys = nodes.select("fp", F.explode("bands").alias("key"))
    held = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.bit_xor(F.xxhash64("fp")).alias("all"))
    shared = staged(held.where("n > 1").groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key", "n"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return compared(keys, shared, total, lambda placed: placed.join(nodes.select("fp", F.col("sketch").alias("value")), "fp"), by_sketch)


def exact_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (a, b) of exactly compared sets within clusters (node, label); the sets are those of the nodes' ``first_id``."""
    rows = clusters.select(F.col("node").alias("fp"), F.col("label").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            texts = part.pop("text")
            same = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64) == part["fp"].to_numpy(np.int64)
            part = part[same]
            yield part.assign(value=[shingle_set(t, hashes).tobytes() for t in texts[same]])

    def fetch(placed: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("first_id"), F.col("text").cast("string").alias("text"))
        chosen = texts.join(placed.join(nodes.select("fp", "first_id"), "fp"), "first_id").select(*PLACED, "text")
        return chosen.mapInPandas(read, ", ".join(f"{c} bigint" for c in PLACED) + ", value binary")

    return compared(rows, counts, rows.count(), fetch, by_set)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and group_id (smallest id of its near-duplicates) of every row."""
    signed = staged(signatures(docs), "signatures")
    best = F.min_by(F.struct("sketch", "bands"), "doc_id")
    nodes = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), best.alias("x"), F.count("*").alias("n"))
    nodes = staged(nodes.where("first_id is not null").select("fp", "first_id", "n", "x.*"), "nodes")
    count = nodes.count()
    similar = exact_links(docs, nodes, components(similar_links(nodes)))
    labels = components(near_links(nodes.select("fp"), 3, count).union(similar))
    named = labels.join(nodes.select("fp", "first_id"), labels["node"] == F.col("fp"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("group_id"))
    linked = named.join(smallest, "label").select("fp", "group_id")
    final = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("group_id", "first_id").alias("group_id"))
    return join_hot(signed.where("doc_id is not null").select("doc_id", "fp"), staged(final, "group_ids"), "fp").select("doc_id", "group_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest id (of equal ids, one), and all rows without id."""
    firsts = staged(groups(docs).where("doc_id = group_id").select("doc_id").distinct(), "firsts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("copy"))
    kept = rows.join(firsts, F.col("id") == F.col("doc_id"), "left_semi").withColumn("rank", rank).where("rank = 1")
    return kept.unionByName(rows.where("id is null"), allowMissingColumns=True).select("row.*")
