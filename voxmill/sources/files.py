"""Readers and writers of point clouds, meshes, labels and listings.

Readers of files that must be parsed whole take a table of files (path, content), as Spark's ``binaryFile`` source gives it. Each file is
read and parsed once by a small helper, and its columns go on as Arrow batches of BATCH rows; keep the results as Parquet. Files of records
(LiDAR) and long arrays (segments) are read in ranges and steps by the data sources of ``stores``, which also has the sink for files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.sources import parsers, stores
from voxmill.staging import kept

FIELDS = ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "label")
#: Rows of a file that are sent on at once.
BATCH = 65_536
#: Columns that are whole numbers; all others are doubles.
WHOLE = {"label": ("int", np.int32), "code": ("bigint", np.int64), "v0": ("bigint", np.int64), "v1": ("bigint", np.int64), "v2": ("bigint", np.int64)}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(files: DataFrame, parse: Callable[[str, bytes], dict], names: tuple[str, ...], row: str = "point_id") -> DataFrame:
    """(path, row number, names...) of each file's rows; columns the file lacks are null."""
    kinds = [WHOLE.get(n, ("double", np.float64)) for n in names]
    schema = f"path string, {row} bigint, " + ", ".join(f"{n} {kind}" for n, (kind, _) in zip(names, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_py()
                found = parse(path.as_py(), data) if data else {}
                size = len(next((found[n] for n in names if n in found), ()))
                for k in range(0, size, BATCH):
                    n = min(BATCH, size - k)
                    columns = [pa.array(np.asarray(found[c][k : k + n]).astype(kind)) if c in found else pa.nulls(n, pa.from_numpy_dtype(kind)) for c, (_, kind) in zip(names, kinds)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(path.as_py(), n), pa.array(np.arange(k, k + n)), *columns], ["path", row, *names])

    return files.select("path", "content").mapInArrow(run, schema)


def _wanted(normal: bool, color: bool, label: bool) -> tuple[str, ...]:
    return FIELDS[:3] + FIELDS[3:6] * normal + FIELDS[6:9] * color + FIELDS[9:] * label


def read_points_npz(files: DataFrame, normal: bool = True, color: bool = True, label: bool = True) -> DataFrame:
    names = _wanted(normal, color, label)
    return _parsed(files, lambda _, data: parsers.npz_points(data), names)


def read_points_ply(files: DataFrame, normal: bool = True, color: bool = True, label: bool = True) -> DataFrame:
    names = _wanted(normal, color, label)
    return _parsed(files, lambda _, data: parsers.ply_points(data), names)


#: Parsers (bytes to columns) by what follows the last dot of a path; users may add their own.
PARSERS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {"npz": parsers.npz_points, "ply": parsers.ply_points}


def point_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` that a parser is known for; no others are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(PARSERS)}}}").load(path).select("path", "content")


def read_points(files: DataFrame, normal: bool = True, color: bool = True, label: bool = True) -> DataFrame:
    """Each file by the parser of its suffix, in one pass over ``files``; files of other kinds have no rows."""
    known = dict(PARSERS)  # as it is now: users' parsers travel with the tasks
    nothing = lambda _: {}
    return _parsed(files, lambda path, data: known.get(path.rpartition(".")[2], nothing)(data), _wanted(normal, color, label))


def read_lidar(spark: SparkSession, path: str, sequences: list[str] | None = None, split: int | None = None) -> DataFrame:
    """(path, sequence, point_id, x, y, z, intensity, label) of the LiDAR scans (.bin) below ``path``.

    Label files lie beside the scans (velodyne -> labels, .bin -> .label) and are read with them, range by range; the label is zero where there is
    none. ``sequences`` are the only ones that are read, if given; ``split`` is the size of a task's range in bytes;
    ranges grow where there would be many more of them than stores.TASKS.
    """
    return stores.read_store(spark, stores.LidarFiles, path, sequences=None if sequences is None else ",".join(sequences), split=split)


def read_lidar_tree(spark: SparkSession, path: str, sequences: dict[str, str]) -> DataFrame:
    """``read_lidar`` of the sequences named, with ``split`` (train, val, test, as ``sequences`` says); train and val rows are of split train_val, too.

    The split follows from the path alone, so points are read once and never shuffled.
    """
    names = F.create_map(*[F.lit(x) for pair in sequences.items() for x in pair])
    points = read_lidar(spark, path, sorted(sequences))
    told = names[F.col("sequence")]
    return points.withColumn("split", F.explode(F.when(told.isin("train", "val"), F.array(told, F.lit("train_val"))).otherwise(F.array(told))))


def read_points_txt(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, nx, ny, nz, label) of lines of numbers."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") > 2)
    return lines.select("path", *[F.get("v", F.lit(k)).cast("double").alias(n) for k, n in enumerate(FIELDS[:6])], F.get("v", F.lit(6)).cast("double").cast("int").alias("label"))


def read_mesh(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, vid, x, y, z) and triangles (path, fid, v0, v1, v2) of PLY, OBJ and OFF files; polygons are cut into triangles.

    Each file is read and parsed once: its rows, with a tag, are written to the shared folder, a folder for each of the two tables.
    """
    names = (("x", "y", "z"), ("v0", "v1", "v2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not content.as_py():
                    continue
                for part, rows in enumerate(parsers.MESHES.get(path.lower().rpartition(".")[2], parsers.off_mesh)(content.as_py())):
                    for k in range(0, len(rows), BATCH):
                        n = min(BATCH, len(rows) - k)
                        own = [pa.array(np.ascontiguousarray(c)) for c in rows[k : k + n].T]
                        other = [pa.nulls(n, pa.int64() if part == 0 else pa.float64())] * 3
                        yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat("vf"[part], n), pa.array(np.arange(k, k + n)), *(own + other if part == 0 else other + own)], ["path", "part", "at", *names[0], *names[1]])

    both = kept(files.select("path", "content").mapInArrow(run, "path string, part string, at bigint, x double, y double, z double, v0 bigint, v1 bigint, v2 bigint"), ["part"])
    return tuple(both.where(F.col("part") == tag).select("path", F.col("at").alias(row), *own) for tag, row, own in (("v", "vid", names[0]), ("f", "fid", names[1])))


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of lines ``name label``."""
    return spark.read.csv(path, sep=" ", schema="name string, label int")


def write_filelist(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "name", F.col("label").cast("string"))).write.text(path)


def read_segments(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, scene, point_id, segment) of the files below ``path`` with arrays segIndices, which are read as a stream; ``scene`` is the sceneId before the array, or null."""
    return stores.read_store(spark, stores.SegmentFiles, path, suffix=suffix)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, label, segments) of files with an array segGroups."""
    rows = spark.read.json(path, multiLine=True, schema="segGroups array<struct<label string, segments array<bigint>>>")
    return rows.select(F.input_file_name().alias("path"), F.posexplode("segGroups").alias("position", "g")).select("path", "position", "g.label", "g.segments")


def read_label_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def letters(points: DataFrame, info: str = "PNFLB", channels: int = 0) -> DataFrame:
    """Columns by letters in their order (points, normals, features, labels, batch), absent ones skipped."""
    groups = {"P": ["x", "y", "z"], "N": ["nx", "ny", "nz"], "L": ["label"], "B": ["cloud_id"]}
    cols = []
    for c in info:
        if c == "F" and "features" in points.columns:
            cols += [F.col("features")[k].alias(f"f{k}") for k in range(channels)]
        else:
            cols += [F.col(n) for n in groups.get(c, []) if n in points.columns]
    return points.select(*cols)


def save_files(files: DataFrame, folder: str) -> None:
    """Write files (path below ``folder``, content) to any store that pyarrow reaches: all of them if the job ends well, else none."""
    files.sparkSession.dataSource.register(stores.FileSink)
    files.select("path", "content").write.format(stores.FileSink.name()).mode("append").save(folder)


def packed_clouds(points: DataFrame, form: str, info: str = "PNFLB", channels: int = 0, rows: int = 1_000_000) -> DataFrame:
    """Files (path, content) of clouds in ``npz`` or ``ply`` form; a cloud becomes one file for every ``rows`` points, about."""
    pack = {"npz": parsers.npz_bytes, "ply": parsers.ply_bytes}[form]
    names = letters(points, info.replace("B", ""), channels).columns
    pieces = points.groupBy("cloud_id").agg(F.ceil(F.count("*") / rows).alias("__pieces"))
    flat = {f"f{k}": F.col("features")[k] for k in range(channels)} if "F" in info and "features" in points.columns else {}
    dealt = points.withColumns(flat).join(pieces, "cloud_id").select(F.col("cloud_id").cast("string").alias("__cloud"), F.pmod(F.xxhash64("point_id"), F.col("__pieces")).alias("__piece"), *names)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}.{form}"], "content": [pack({n: part[n].to_numpy() for n in names})]})

    return dealt.groupBy("__cloud", "__piece").applyInPandas(run, "path string, content binary")


def write_points(points: DataFrame, path: str, info: str = "PNFLB", channels: int = 0, form: str = "parquet") -> None:
    """Parquet; ``xyz`` text (values with six digits joined by spaces); or ``npz`` and ``ply`` files, a folder for each cloud."""
    if form in ("npz", "ply"):
        save_files(packed_clouds(points, form, info, channels), path)
        return
    chosen = letters(points, info, channels)
    if form == "parquet":
        chosen.write.parquet(path)
    else:
        chosen.select(F.concat_ws(" ", *[F.format_string("%.6f", F.col(c).cast("double")) for c in chosen.columns])).write.text(path)


def write_clouds(points: DataFrame, path: str, rows: int = 4_000_000) -> None:
    """A folder for each cloud, with one file for every ``rows`` points, about: a huge cloud is written by many tasks."""
    pieces = points.groupBy("cloud_id").agg(F.ceil(F.count("*") / rows).alias("__pieces"))
    dealt = points.join(pieces, "cloud_id").withColumn("__piece", F.pmod(F.xxhash64("point_id"), F.col("__pieces")))
    dealt.repartition("cloud_id", "__piece").select(*points.columns).write.partitionBy("cloud_id").parquet(path)
