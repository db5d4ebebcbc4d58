"""Token counts through a digest cache.

Texts are keyed by SHA-256; counts are stored under (text digest, tokenizer digest). Digests
missing from the cache are encoded once each, however many rows share the text, and appended.
Content is normalised only as far as no count can change: null is the empty text.

Repeated rows each get their count; a null id stays null; an empty table gives an empty result. Long texts are counted
whole. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import join_hot, release_shuffles, shared_dir, staged

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"

#: Fixed value: how byte-level BPE vocabularies of this kind cut text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose classes might differ between regular expression libraries.
UNSURE = regex.compile(r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027]")


class TokenCounter:
    """Counts tokens as the file's own library does: ``tokenizers`` or ``sentencepiece``.

    For byte-level BPE without a normaliser a text's count is the sum over its pieces, so
    pieces are remembered (``limit`` at most) and only new ones encoded. Texts with added
    tokens or unusual characters go to the library whole.
    """

    def __init__(self, path: str, limit: int = 600_000) -> None:
        self.limit, self.known = limit, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_piece = False
            return
        from tokenizers import Tokenizer

        told = json.loads(Path(path).read_text(encoding="utf-8"))
        model = Tokenizer.from_file(path)
        model.no_padding()
        model.no_truncation()
        self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        cutter = told.get("pre_tokenizer") or {}
        self.by_piece = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not told.get("normalizer") and told["model"]["type"] == "BPE"
        self.added = [x["content"] for x in told.get("added_tokens") or []]
        self.cut = regex.compile(CUTS).findall

    def count(self, text: str) -> int:
        if not self.by_piece or UNSURE.search(text) or any(x in text for x in self.added):
            return self.lengths([text])[0]
        pieces = self.cut(text)
        new = [x for x in set(pieces) if x not in self.known]
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known = {}
                new = list(set(pieces))
            self.known.update(zip(new, self.lengths(new)))
        return sum(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file and of the version of its library."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(library).__version__
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version}".encode()).hexdigest()


def empty_cache(spark: SparkSession) -> str:
    """A new cache in the shared folder."""
    path = f"{shared_dir(spark)}/token_counts"
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return path


def content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest and n_bytes of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(content(text), 256)).alias("digest"), F.octet_length(content(text)).cast("long").alias("n_bytes"))


def add_misses(docs: DataFrame, path: str, cache: str, text: str = "text", keys: DataFrame | None = None) -> None:
    """Encode each text whose digest the cache lacks, once, and append the counts to the cache.

    Digests are counted and held against the cache first, so that only texts of missing ones are moved. Digests of over a
    thousandth of these rows, at most a thousand, are met by broadcast and thinned out before any shuffle.
    """
    spark = docs.sparkSession
    name = tokenizer_digest(path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == name).select("digest")
    keys = keyed(docs, text) if keys is None else keys
    missing = staged(keys.groupBy("digest").agg(F.count("*").alias("n")).join(stored, "digest", "left_anti"), "missing")
    total = missing.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return
    texts = docs.select(F.unhex(F.sha2(content(text), 256)).alias("digest"), content(text).alias("content"))
    hot = F.broadcast(missing.where(F.col("n") > total / 1000).select("digest"))
    cold = missing.where(F.col("n") <= total / 1000).select("digest")
    once = [texts.join(hot, "digest", "left_semi"), texts.join(hot, "digest", "left_anti").join(cold, "digest", "left_semi")]

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path).count
        for part in parts:
            yield pd.DataFrame({"digest": part["digest"], "tokenizer": name, "n_tokens": [count(x) for x in part["content"]]})

    misses = once[0].dropDuplicates(["digest"]).union(once[1].dropDuplicates(["digest"]))
    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    release_shuffles(spark)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``cache`` is a table made by ``empty_cache``; None starts a new one. It is brought up to
    date first, so a second call with the same cache encodes nothing.
    """
    spark = docs.sparkSession
    cache = cache or empty_cache(spark)
    keys = staged(keyed(docs, text), "keys")
    add_misses(docs, path, cache, text, keys)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer_digest(path))
    rows = keys.groupBy("digest").agg(F.count("*").alias("n"))
    counts = staged(rows.join(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest"), "counts")
    return join_hot(keys, counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
