"""Bigram scores by deleted interpolation.

P(w | v) = a2 c(v w)/c(v) + a1 c(w)/N + a0/(V + 1), where the weights depend on how often the
context v was seen (one set for every power of two). They are learned by
expectation-maximisation on one part of the training documents, held out from the counts
used there; the scores use the counts of all training documents.

Documents are dealt to chunks by a hash. A chunk sends its distinct n-grams (64-bit hashes) to
ranges of hash values; a range adds up the counts and answers each chunk position by position,
so neither n-grams nor counts travel twice and nothing is broadcast. Chunks and ranges have
a bounded size, their numbers grow with the corpus. An n-gram is listed once a chunk, so a word that
makes up a third of a corpus is no larger than any other.

Null text is empty (one end token); a null id is treated as the empty id when folds are dealt
and returned as null. Repeated rows are scored, and counted, each. Long texts are read whole; ties do not arise, as all counts
enter. Other columns than the id and the text are not read and may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import lower_words, mix, release_shuffles, staged

#: Of crc32(id) mod FOLDS: scored but not learned from; held out for the mixture weights.
FOLDS, HELD_OUT, TUNING = 5, 1, 2
#: Bytes of text in a chunk, and of text behind a range of hashes.
CHUNK_BYTES, RANGE_BYTES = 9 << 20, 4 << 20
#: Tokens that stand for the start (a context only) and the end of a text: no words.
START, END = b"", b" "
#: Probabilities are told apart by an eighth of a doubling when weights are learned.
STEPS = 8
ROUNDS = 200


class Index(dict):
    """word -> its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Chunk:
    """The n-grams of some texts: ``keys`` sorted, how often each occurs, and where tokens find theirs."""

    def __init__(self, texts: "pd.Series", places: bool = False) -> None:
        index = Index()
        start, end = index[START], index[END]
        parts = []
        for text in texts:
            tokens = lower_words(text)
            ids = np.empty(len(tokens) + 2, np.int64)
            ids[0], ids[-1] = start, end
            ids[1:-1] = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
            parts.append(ids)
        self.sizes = np.array([len(x) - 1 for x in parts])  # tokens of each text, the end included
        ids = np.concatenate(parts)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(self.sizes + 1) - self.sizes - 1] = False  # the starts
        before, now = ids[:-1][inner[1:]], ids[1:][inner[1:]]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in index), np.uint64, len(index))
        codes = before * len(index) + now
        if places:
            pairs, at, n2 = np.unique(codes, return_inverse=True, return_counts=True)
        else:
            pairs, n2 = np.unique(codes, return_counts=True)
        n1 = np.bincount(ids, minlength=len(index))
        # odd keys are words, even keys are pairs
        one = mix(hashes) | np.uint64(1)
        two = mix(hashes[pairs // len(index)] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs % len(index)]) & ~np.uint64(1)
        keys = np.concatenate([one, two])
        order = np.argsort(keys)
        self.keys, self.n = keys[order], np.concatenate([n1, n2])[order]
        if places:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.context, self.word, self.pair = rank[before], rank[now], rank[len(index) + at]


def packed(counts: np.ndarray) -> bytes:
    """Counts are mostly small and alike: a few bits each."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def narrow(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes each (eight if one is larger), after a byte that says which."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[0] = 0
    width = 6 if not len(gaps) or int(gaps.max()) < 1 << 48 else 8
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[0]
    if len(data) == 1:
        return np.empty(0, np.uint64)
    gaps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + np.frombuffer(data, np.uint64, 1, 1)


START_KEY = mix(np.array([xxhash.xxh64_intdigest(START, 42)], np.uint64))[0] | np.uint64(1)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole part of log2."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def parts(c2: np.ndarray, cv: np.ndarray, c1: np.ndarray, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    return c2 / np.maximum(cv, 1), c1 / max(total, 1), 1 / (kinds + 1)


def learn(cells: pd.DataFrame, p0: float) -> np.ndarray:
    """Mixture weights (bucket, 3) from cells (b, q2, q1, n) of held-out tokens, by EM."""
    top = int(cells["b"].max()) if len(cells) else 0
    weights = np.tile([0.4, 0.4, 0.2], (64, 1))
    for b in range(top + 1):
        own = cells[cells["b"] == b]
        if not len(own):
            if b:
                weights[b] = weights[b - 1]
            continue
        p = np.stack([np.where(own[q] < 0, 0.0, 2.0 ** (-(own[q].to_numpy(np.float64)) / STEPS)) for q in ("q2", "q1")] + [np.full(len(own), p0)], 1)
        n = own["n"].to_numpy(np.float64)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(1, keepdims=True)
            new = (n[:, None] * share).sum(0) / n.sum()
            moved = np.abs(new - w).max()
            w = new
            if moved < 1e-9:
                break
        w = np.maximum(w, 1e-6)
        weights[b] = w / w.sum()
    weights[top + 1 :] = weights[top]
    return weights


def interpolated_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(content).cast("long") + 64), F.lit(0))).first()[0]
    spread = max(1, ceil(size / FOLDS / CHUNK_BYTES))
    bits = max(0, ceil(log2(max(size, 1) / RANGE_BYTES)))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = docs.select(F.col("doc_id").cast("string"), content.alias("content"), (fold * spread + F.pmod(F.xxhash64("doc_id", content), F.lit(spread))).cast("long").alias("chunk"))

    def send(part: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(part["content"])
        number = int(part["chunk"].iloc[0])
        n = chunk.n if number // spread != HELD_OUT else np.zeros_like(chunk.n)
        at = chunk.keys >> np.uint64(64 - bits) if bits else np.zeros(len(chunk.keys), np.uint64)
        some, first = np.unique(at, return_index=True)  # the ranges that this chunk reaches
        cuts = list(zip(first, [*first[1:], len(at)]))
        return pd.DataFrame({"part": some.astype(np.int64), "chunk": number, "keys": [narrow(chunk.keys[a:b]) for a, b in cuts], "n": [n[a:b].astype(np.int32) for a, b in cuts]})

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        lists = [widened(x) for x in part["keys"]]
        sizes = np.array([len(x) for x in lists])
        keys = np.concatenate(lists)
        n = np.concatenate(part["n"].to_list()).astype(np.int64)
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) != 0)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        tuning = np.repeat(part["chunk"].to_numpy() // spread == TUNING, sizes)
        total = np.bincount(group, n).astype(np.int64)
        rest = np.bincount(group, np.where(tuning, 0, n)).astype(np.int64)
        kind = keys[order][new]
        word = ((kind & np.uint64(1)) == 1) & (kind != START_KEY)
        ends = np.cumsum(sizes)[:-1]
        out = {"chunk": [*part["chunk"], -1], "part": [*part["part"], int(part["part"].iloc[0])]}
        for name, count in (("total", total), ("rest", rest)):
            out[name] = [packed(x) for x in (*np.split(count[group], ends), np.array([count[word].sum(), (count[word] > 0).sum()]))]
        return pd.DataFrame(out)

    def counts(part: pd.DataFrame, name: str) -> np.ndarray:
        return np.concatenate([unpacked(x) for x in part.sort_values("part")[name]])

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(*unpacked(a), *unpacked(b)) for a, b in zip(part["total"], part["rest"])], columns=list("abcd"))

    def cells(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"b": [], "q2": [], "q1": [], "n": []}, dtype=np.int64)
        chunk, count = Chunk(part["content"], places=True), counts(told, "rest")
        p2, p1, _ = parts(count[chunk.pair], count[chunk.context], count[chunk.word], rest_tokens, rest_kinds)
        step = lambda p: np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), -1).astype(np.int64)
        found = pd.DataFrame({"b": bucket(count[chunk.context]), "q2": step(p2), "q1": step(p1)})
        return found.groupby(["b", "q2", "q1"]).size().reset_index(name="n")

    def scores(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"doc_id": part.get("doc_id", []), "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})
        chunk, count = Chunk(part["content"], places=True), counts(told, "total")
        c1, cv = count[chunk.word], count[chunk.context]
        p2, p1, p0 = parts(count[chunk.pair], cv, c1, tokens, kinds)
        w = weights[bucket(cv)]
        first = np.cumsum(chunk.sizes) - chunk.sizes
        by_text = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy(), "held_out": int(key[0]) // spread == HELD_OUT, "n_tokens": chunk.sizes, "n_known": by_text((c1 > 0).astype(np.int64)), "train_tokens": tokens,
            "base_score": by_text(np.log10((c1 + 0.5) / (tokens + 0.5 * (kinds + 1)))), "score": by_text(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)),
        })

    sent = rows.groupBy("chunk").applyInPandas(send, "part bigint, chunk bigint, keys binary, n array<int>")
    told = staged(sent.groupBy("part").applyInPandas(answer, "chunk bigint, part bigint, total binary, rest binary"), "counts")
    sums = told.where("chunk = -1").select("total", "rest").mapInPandas(add, "a bigint, b bigint, c bigint, d bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "abcd")).first()
    tokens, kinds, rest_tokens, rest_kinds = map(int, sums)
    tune = F.expr(f"chunk div {spread} = {TUNING}")
    found = rows.where(tune).groupBy("chunk").cogroup(told.where(tune).groupBy("chunk")).applyInPandas(cells, "b bigint, q2 bigint, q1 bigint, n bigint")
    weights = learn(found.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).toPandas(), 1 / (rest_kinds + 1))
    release_shuffles(spark)
    schema = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("chunk").cogroup(told.where("chunk >= 0").groupBy("chunk")).applyInPandas(scores, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
