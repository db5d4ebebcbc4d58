"""Importance resampling with hashed n-gram models.

Two generative models over hashed words and word pairs, one of all documents and one of
labelled good ones, give each document a log ratio per n-gram. A second ratio asks how much a
document's words (and their beginnings) speak for the labels to avoid. The log weight of a document is the
lesser of the two log ratios, each measured from a zero point and in a unit fitted on labelled rows left out of
the models. Documents are drawn without replacement by Gumbel top-k: log weight plus seeded Gumbel noise, the
``k`` largest. By default k is the number of positive weights. The k-th key is found exactly by counting keys by
their digits, so nothing is sorted or gathered.

Labels are taken from a bounded sample (about ``LABELLED`` rows, those with the smallest hashes); the
model of all documents covers every row. Nulls: a null text is empty and has weight zero evidence;
null ids share one noise value; null labels count as absent. Equal keys at the boundary are
all kept. Repeated rows are judged each; of rows that share a labelled id, the least good evidence stands for the label.
Without usable labels every document has the same weight, and by default is kept. Long texts are read whole. Other columns
of documents pass through the pipeline's form untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import WordHashes, lower_words, mix, release_shuffles, staged, uniform

#: Buckets of each n-gram model: 2 ** BITS.
BITS = 18
AVOID_BITS = 20
#: Labelled rows that are used, on average at most.
LABELLED = 50_000
#: Added to both counts of a ratio: rare n-grams prove little.
PRIOR, AVOID_PRIOR = 5.0, 1.0
#: Words must surely be so much more frequent (in logarithms) among documents to avoid, where
#: surely means: by so many standard deviations of their count.
AVOID_CUT, AVOID_SURE = 1.4, 1.0
#: Log weights are so many Gumbel units for each unit of margin.
SHARPNESS = 40.0
#: A good document lost counts as much as so many bad ones kept, when thresholds are fitted.
CARE = 10.0
#: Keys are whole millionths, counted by three digits of 16 bits.
DIGITS, KEY_BITS = 1 << 16, 48


def ngram_buckets(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
    return (mix(ids) >> shift).astype(np.int64), (mix(pairs) >> shift).astype(np.int64)


class WordBuckets(dict):
    """token -> buckets of the word without punctuation and of its first four and five bytes; limited in size.

    With ``only`` (a table of lifts), buckets without lift are left out.
    """

    def __init__(self, only: np.ndarray | None = None, limit: int = 500_000) -> None:
        super().__init__()
        self.only, self.limit = only, limit

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        word = token.strip(b".,;:!?\"'()")
        parts = [word, *(b"\0" + word[:n] for n in (4, 5) if len(word) > n)]
        found = [xxhash.xxh64_intdigest(p, 7) >> (64 - AVOID_BITS) for p in parts]
        value = self[token] = tuple(b for b in found if self.only is None or self.only[b] > 0)
        return value

    def of(self, tokens: list[bytes]) -> list[int]:
        """Buckets of the distinct words."""
        return sorted({b for t in set(tokens) for b in self[t]})


@dataclass
class Model:
    """Fitted log ratios and thresholds; two arrays of 2 ** BITS and one of 2 ** AVOID_BITS floats."""

    words: np.ndarray
    pairs: np.ndarray
    avoid: np.ndarray
    accept: tuple[float, float] = (-math.inf, 1.0)
    refuse: tuple[float, float] = (math.inf, 1.0)

    def evidence(self, texts: "pd.Series", hashes: WordHashes, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
        ratio, against = np.zeros(len(texts)), np.zeros(len(texts))
        for k, text in enumerate(texts):
            tokens = lower_words(text)
            if tokens:
                one, two = ngram_buckets(hashes.array(tokens))
                ratio[k] = (self.words[one].sum(dtype=np.float64) + self.pairs[two].sum(dtype=np.float64)) / len(tokens)
                against[k] = self.avoid[np.array(buckets.of(tokens), np.int64)].sum(dtype=np.float64)
        return ratio, against


def threshold(values: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The cut (good above) of the least weighted error, midway in its gap, and a scale."""
    if not good.any() or good.all():
        return -math.inf, 1.0
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    right = np.cumsum(~g) / (~g).sum() - CARE * np.cumsum(g) / g.sum()
    right = np.where(np.append(np.diff(v) > 0, False), right, -CARE)
    best = int(np.argmax(right))
    if right[best] <= 0:
        return -math.inf, 1.0
    spread = float(np.std(v[g])) or 1.0
    return float((v[best] + v[min(best + 1, len(v) - 1)]) / 2), spread


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """About ``LABELLED`` rows at most: doc_id, fine, good, bad (to avoid), hold (not learned from), first.

    Of documents with equal texts one is the first; the others' words don't count as proof of bad.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = one.select("doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("fine"), (F.coalesce("toxic", F.lit(0)) == 1).alias("bad"), F.xxhash64("doc_id").alias("h")).where(uniform(3, F.col("doc_id")) < LABELLED / max(one.count(), 1))
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("copy")).join(F.broadcast(some), "doc_id")
    firsts = texts.groupBy("copy").agg(F.min("doc_id").alias("first_id")).select(F.col("first_id").alias("doc_id"), F.lit(True).alias("first")).distinct()
    flagged = some.join(firsts, "doc_id", "left")
    return flagged.select("doc_id", "fine", (F.col("fine") & ~F.col("bad")).alias("good"), "bad", (F.pmod("h", F.lit(2)) == 0).alias("hold"), F.coalesce("first", F.lit(False)).alias("first"))


def count_grams(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """kind (0 words, 1 pairs, 2 words of labelled documents), bucket, and two counts: all, wanted."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left").select("text", "good", "bad", "hold", "first")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, buckets = WordHashes(), WordBuckets()
        sizes = (1 << BITS, 1 << BITS, 1 << AVOID_BITS)
        seen = [[np.zeros(n, np.int64), np.zeros(n, np.int64)] for n in sizes]
        for part in parts:
            for text, good, bad, hold, first in zip(part["text"], part["good"], part["bad"], part["hold"], part["first"]):
                tokens = lower_words(text)
                if not tokens:
                    continue
                for kind, at in enumerate(ngram_buckets(hashes.array(tokens))):
                    np.add.at(seen[kind][0], at, 1)
                    if good is True and hold is False:
                        np.add.at(seen[kind][1], at, 1)
                if hold is False and first is True:
                    at = buckets.of(tokens)
                    seen[2][0][at] += 1
                    if bad is True:
                        seen[2][1][at] += 1
        for kind, (every, wanted) in enumerate(seen):
            at = np.flatnonzero(every)
            yield pd.DataFrame({"kind": kind, "bucket": at, "n": every[at], "wanted": wanted[at]})

    counts = rows.mapInPandas(run, "kind int, bucket int, n bigint, wanted bigint")
    return counts.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("wanted").alias("wanted"))


def log_ratio(n: np.ndarray, wanted: np.ndarray, prior: float, share: float) -> np.ndarray:
    return np.log((wanted + prior) / (n * share + prior)).astype(np.float32)


def least_wanted() -> int:
    """The fewest documents to avoid that a word must occur in to have any lift."""
    return next(n for n in count(1) if log_ratio(np.zeros(1), np.array([max(n - AVOID_SURE * math.sqrt(n), 0)]), AVOID_PRIOR, 0)[0] > AVOID_CUT)


def fit(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[Model, DataFrame]:
    """The model, with thresholds, and the scores (``keep``, ratio, against) of every row."""
    sample = staged(labelled_sample(docs, labels), "labelled")
    # at most 2 * 2 ** BITS rows, and the words that can have a lift
    counts = count_grams(docs, sample).where((F.col("kind") < 2) | (F.col("wanted") >= least_wanted())).toArrow().to_pandas()
    release_shuffles(docs.sparkSession)
    totals = sample.where("first and not hold").agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first()
    tables = []
    for kind, bits in enumerate((BITS, BITS, AVOID_BITS)):
        n, wanted = np.zeros(1 << bits), np.zeros(1 << bits)
        own = counts[counts["kind"] == kind]
        n[own["bucket"]], wanted[own["bucket"]] = own["n"], own["wanted"]
        if kind < 2:
            tables.append(log_ratio(n, wanted, PRIOR, wanted.sum() / max(n.sum(), 1)) if wanted.sum() else np.zeros(1 << bits, np.float32))
        else:
            sure = np.maximum(wanted - AVOID_SURE * np.sqrt(wanted), 0)
            lift = log_ratio(n, sure, AVOID_PRIOR, (totals[1] or 0) / max(totals[0], 1))
            tables.append(np.where(lift > AVOID_CUT, lift, 0).astype(np.float32))
    model = Model(*tables)
    scores = staged(evidence(docs, model, *keep), "scores")
    held = sample.where("hold").select("doc_id", "fine", "bad")
    known = scores.select("doc_id", "ratio", "against").join(F.broadcast(held), "doc_id").groupBy("doc_id", "fine", "bad").agg(F.min("ratio").alias("ratio"), F.max("against").alias("against")).toPandas()
    model.accept = threshold(known["ratio"].to_numpy(), known["fine"].to_numpy(bool))
    cut, spread = threshold(-known["against"].to_numpy(), ~known["bad"].to_numpy(bool))
    model.refuse = -cut, spread
    return model, scores


def evidence(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` and, for each row, ratio (target over raw, a token) and against (to avoid)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, buckets = WordHashes(), WordBuckets(shared.value.avoid)
        for texts in parts:
            ratio, against = shared.value.evidence(texts, hashes, buckets)
            yield pd.DataFrame({"ratio": ratio, "against": against})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judged = docs.withColumn("__evidence", F.pandas_udf(run, "ratio double, against double")(F.col("text").cast("string")))
    return judged.select(*keep, "__evidence.ratio", "__evidence.against")


def gumbel_key(model: Model, seed: int) -> tuple[F.Column, F.Column]:
    """Log weight, and the key it is drawn by: weight plus noise in millionths."""
    margins = []
    for name, (cut, spread), sign in (("ratio", model.accept, 1), ("against", model.refuse, -1)):
        if math.isfinite(cut):
            margins.append(sign * (F.col(name) - F.lit(cut)) / F.lit(spread))
    margin = F.least(*margins) if len(margins) > 1 else margins[0] if margins else F.lit(1.0)
    weight = margin * SHARPNESS
    noise = -F.log(-F.log(uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    most = float(1 << (KEY_BITS - 1)) - 1  # 140 million Gumbel units
    return weight, F.floor(F.greatest(F.least((weight + noise) * 1e6, F.lit(most)), F.lit(-most))).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of ``key`` (within 2 ** 47), by three counts over 16 bits each; None if there are fewer."""
    high, above = 0, 0
    moved = keys.select((F.col("key") + F.lit(1 << (KEY_BITS - 1))).alias("key"))
    for shift in range(KEY_BITS - 16, -1, -16):
        rows = moved.where(F.shiftright("key", shift + 16) == high)
        counts = rows.groupBy(F.pmod(F.shiftright("key", shift), F.lit(DIGITS)).alias("digit")).count().toPandas()  # DIGITS rows at most
        counts = counts.sort_values("digit", ascending=False)
        reach = above + counts["count"].cumsum().to_numpy()
        at = int(np.searchsorted(reach, k))
        if at >= len(reach):
            return None
        above = int(reach[at] - counts["count"].iloc[at])
        high = (high << 16) + int(counts["digit"].iloc[at])
    return high - (1 << (KEY_BITS - 1))


def draw(scores: DataFrame, model: Model, seed: int = 42, k: int | None = None) -> DataFrame:
    """The ``k`` drawn rows of ``scores`` (by default as many as have a positive weight) with log_weight and key.

    All rows are drawn if there are no more than k.
    """
    weight, key = gumbel_key(model, seed)
    keyed = scores.select("*", weight.alias("log_weight"), key.alias("key"))
    k = keyed.where("log_weight > 0").count() if k is None else k
    if k <= 0:
        return keyed.limit(0)
    cut = kth_largest(keyed, k)
    return keyed if cut is None else keyed.where(F.col("key") >= cut)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42, k: int | None = None) -> DataFrame:
    """The documents drawn: doc_id, their evidence, log weight and Gumbel key."""
    model, scores = fit(docs, labels)
    drawn = draw(scores, model, seed, k)
    return drawn.select("doc_id", "ratio", "against", "log_weight", (F.col("key") / 1e6).alias("gumbel_key"), F.lit(True).alias("selected"))


def keep_drawn(docs: DataFrame, labels: DataFrame, seed: int = 42, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with their own columns, judged in the same pass."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    model, scores = fit(inner, labels, ("__row", "doc_id"))
    return draw(scores, model, seed, k).select("__row.*")
