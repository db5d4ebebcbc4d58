"""File listings, splits and batches. Listings are small tables of names, ordered by explicit columns."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.ranks import free, ranked


#: Rows of a list that are ordered in one task, where positions say where to cut.
PIECE = 4096


def take(files: DataFrame, total: int, ratio: float, order: str = "position", block: Column | None = None) -> DataFrame:
    """The first ceil(total * ratio) files of a list, ordered by its distinct values of ``order``.

    ``block`` cuts the list into pieces along ``order`` (see ``ranked``): by default PIECE positions each.
    """
    block = F.floor(F.col(order) / PIECE) if block is None else block
    (rank,) = free(files, "rank")
    return ranked(files, block, [F.col(order)], name=rank).where(F.col(rank) < ceil(total * ratio)).drop(rank)


def assign_batches(clouds: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """``batch`` and ``batch_idx`` of each cloud, in list order (``position``) or in a seeded order."""
    if seed is None:
        block, order = F.floor(F.col("position") / PIECE), [F.col("position")]
    else:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cloud_id").cast("string")))
        block, order = F.substring(digest, 1, 4), [digest, F.col("cloud_id")]
    (rank,) = free(clouds, "rank")
    placed = ranked(clouds, block, order, name=rank)
    return placed.select(*clouds.columns, F.floor(F.col(rank) / size).cast("long").alias("batch"), (F.col(rank) % size).cast("int").alias("batch_idx"))


def class_index(files: DataFrame) -> DataFrame:
    """``category_id``: the position of the category in the sorted list of categories."""
    index = files.select("category").distinct().withColumn("category_id", F.row_number().over(Window.orderBy("category")) - 1)
    return files.join(index, "category")  # one row a folder; Spark broadcasts it if its size allows it


def numbered(files: DataFrame, by: list[str], block: Column | None) -> DataFrame:
    """``by`` and name of files, with ``rank`` by name and the number ``n`` within ``by``.

    ``block`` cuts the names into pieces of bounded size, in their order (a prefix of them, say; see ``ranked``); without it a category is one piece.
    """
    named = files.select(*by, "name", (F.lit(0) if block is None else block).alias("piece"))
    counts = named.groupBy(*by).agg(F.count("*").alias("n"))
    theirs = counts.withColumnsRenamed({c: f"of_{c}" for c in by})
    return ranked(named, F.col("piece"), [F.col("name")], by).join(theirs, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by])


def ratio_split(files: DataFrame, ratios: list[float], block: Column | None = None) -> DataFrame:
    """For each ratio the first ceil(n * ratio) files, by name, of each category and split. ``block``: see ``numbered``."""
    wide = numbered(files, ["category", "split"], block).withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    return wide.where(F.col("rank") < F.ceil(F.col("n") * F.col("ratio"))).select("ratio", "category", "split", "name")


def sequence_split(files: DataFrame, sequences: DataFrame) -> DataFrame:
    """Files by the split of their sequence (sequence, split); train_val is both of train and val."""
    told = files.join(sequences, "sequence")
    both = told.where(F.col("split").isin("train", "val")).withColumn("split", F.lit("train_val"))
    return told.unionByName(both)


def category_filelists(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines (list, position, line) that have a category (category, category_id) as a part of their path, train before val.

    ``line`` is cut to begin with that part and gets the category's index. Lines are met by equal parts, never compared with
    every category; a line with a part twice counts once, from its first place.
    """
    rank = F.when(F.col("list") == "train", 0).when(F.col("list") == "val", 1).otherwise(2)
    parts = F.split("line", "/")
    named = lines.select("*", F.explode(F.array_distinct(parts)).alias("category"))
    met = named.join(categories, "category")
    cut = F.array_join(F.expr("slice(split(line, '/'), array_position(split(line, '/'), category), size(split(line, '/')))"), "/")
    return met.select(F.when(F.col("list") == "test", "test").otherwise("train_val").alias("list"), "category", rank.alias("part"), "position", F.concat_ws(" ", cut, F.col("category_id").cast("string")).alias("line"))


def with_category(files: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the ``category`` of the folder (folder, category) that stands in their path; others are left out.

    Paths are cut at slashes and met by equal parts; the first of a path's folders that is known counts.
    """
    cut = files.select(F.col(path).alias("path")).distinct().select("path", F.posexplode(F.split("path", "/")).alias("place", "folder"))
    found = cut.join(folders.select("folder", "category"), "folder").groupBy("path").agg(F.min_by("category", "place").alias("category"))
    return files.join(found.withColumnRenamed("path", path), path).select(*files.columns, "category")


def match_listings(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Files of a that have a partner in b."""
    return a.join(b.select(*on), on, "left_semi")


def drop_listed(files: DataFrame, blacklist: DataFrame, on: list[str]) -> DataFrame:
    return files.join(blacklist.select(*on), on, "left_anti")


def holdout_split(files: DataFrame, partners: DataFrame, ratio: float, block: Column | None = None) -> DataFrame:
    """Of the files that both listings have, the first int(ratio * n) by name of each category train, the others test. ``block``: see ``numbered``."""
    both = numbered(match_listings(files, partners, ["name"]), ["category"], block)
    return both.select("category", "name", F.when(F.col("rank") < F.floor(F.col("n") * F.lit(ratio)), "train").otherwise("test").alias("split"))


def rewrite_suffix(lines: DataFrame, old: str, new: str) -> DataFrame:
    return lines.withColumn("line", F.replace("line", F.lit(old), F.lit(new)))


def union_listings(a: DataFrame, b: DataFrame) -> DataFrame:
    """One after the other; repeated names stay."""
    return a.unionByName(b)


def intersect_listings(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))
