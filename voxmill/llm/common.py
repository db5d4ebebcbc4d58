"""What the text operators share: words, hashes and tables staged between jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def by_row(make: Callable[[], Callable[..., tuple]], schema: str) -> Callable[..., Column]:
    """A column function from values to a struct of ``schema``.

    ``make`` is called once for each task and returns what is called for each row. Other columns of the
    table, ids above all, never leave Spark: pandas would turn long ids beside a null into floats.
    """
    names = StructType.fromDDL(schema).names

    def frame(one: Callable[..., tuple], columns: tuple[pd.Series, ...]) -> pd.DataFrame:
        rows = [one(*row) for row in zip(*columns)]
        return pd.DataFrame({n: pd.Series([row[k] for row in rows], dtype=object) for k, n in enumerate(names)})

    def single(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = make()
        for part in parts:
            yield frame(one, (part,))

    def several(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        one = make()
        for part in parts:
            yield frame(one, part)

    single.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    several.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return lambda *columns: F.pandas_udf(single if len(columns) == 1 else several, schema)(*columns)


def signed(x: int) -> int:
    """64 unsigned bits as a long."""
    return x - (1 << 64) if x >> 63 else x


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the files of shuffles that no plan refers to any more.

    The cleaner learns of them from the driver's garbage collector, which may not run for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables between the steps of one job, under ``spark.checkpoint.dir``.

    A table is dropped once the steps that read it are themselves written; what is returned to the caller stays.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, shared_dir(spark)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        release_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each ``key`` once and in ``weight`` its rows.

    Keys with over a thousandth of the weight are at most a thousand, so they are broadcast;
    the rest is shuffled, and no key of it is hot.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) > F.lit(total / 1000)
    few = table.where(hot).drop(weight)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot).drop(weight), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009..U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def lower_words(text: str | None) -> list[bytes]:
    """As ``words`` with A-Z in lower case; other letters stay."""
    return (text or "").encode("utf-8", "replace").lower().split()


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when ``limit`` words are held."""

    def __init__(self, limit: int = 500_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` ids, in order (empty if there are fewer)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _ODD + np.uint64(k)) + ids[k : len(ids) - n + 1 + k]
    return mix(out)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` ids by a polynomial over one running sum: cost free of ``n``."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(len(ids) + 1, _ODD)) * np.uint64(1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids) * powers[: len(ids)], out=total[1:])
    inverse = np.cumprod(np.full(len(ids) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64))))
    first = np.arange(len(ids) - n + 1)
    return mix((total[first + n] - total[first]) * inverse[first])


def uniform(*parts: object) -> Column:
    """A seeded uniform in (0, 1) of the given columns or literals."""
    cols = [p if not isinstance(p, int | str | float) else F.lit(p) for p in parts]
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
