"""Data sources over any store that pyarrow reaches: LiDAR scans, segment files, and a sink for whole files.

Readers list the store once, cut what they found to ranges of bytes, and read in the tasks, in Arrow batches of bounded size:
nothing is shuffled, and one large file is many tasks. The sink writes below a temporary folder; a file appears under its
name only when all tasks are done (commit), and a job that fails leaves none (abort); what tasks that are still running then write
stays in the temporary folder, which readers pass over.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, about, and rows of a batch.
SPLIT, BATCH = 32 << 20, 1 << 17
#: What opening a file costs, in bytes read: a task has some 256 small files at most.
OPEN = 128 << 10
#: Tasks of a read of LiDAR scans, about (at most twice as many): each has a fixed cost and a place in the driver, so where there would be more, ranges grow.
TASKS = 1 << 12
#: Bytes of a LiDAR record (four floats) and of its label.
RECORD, CODE = 16, 4


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files below ``path`` that have one of the suffixes, in order."""
    files, root = store(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(suffixes) and "/_temporary-" not in x.path)


@dataclass
class Ranges(InputPartition):
    """Parts of files that one task reads: (path, first record, records, records of the label file or -1)."""

    parts: list[tuple[str, int, int, int]]


def label_path(scan: str) -> str:
    """Where the labels of a scan lie."""
    return re.sub(r"\.bin$", ".label", scan.replace("velodyne", "labels"))


class LidarReader(DataSourceReader):
    """Reads each range of a scan side by side with the same range of its label file."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT)) // RECORD
        self.sequences = set(options["sequences"].split(",")) if "sequences" in options else None

    def partitions(self) -> list[InputPartition]:
        files = dict(listed(self.path, (".bin", ".label")))
        scans = {scan: n for scan, n in files.items() if scan.endswith(".bin") and (self.sequences is None or sequence_of(scan) in self.sequences)}
        split = max(self.split, -(-sum(scans.values()) // (RECORD * TASKS)))
        out, held, size = [], [], 0
        for scan, n in scans.items():
            if n % RECORD:
                raise ValueError(f"{scan} does not consist of whole records")
            codes = files.get(label_path(scan), -CODE) // CODE
            for first in range(0, n // RECORD, split):
                part = (scan, first, min(split, n // RECORD - first), codes)
                if held and size + part[2] > split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(part)
                size += part[2]
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        for scan, first, count, codes in partition.parts:
            with files.open_input_file(scan) as points:
                for at in range(first, first + count, BATCH):
                    n = min(BATCH, first + count - at)
                    rows = np.frombuffer(points.read_at(n * RECORD, at * RECORD), "<f4").reshape(-1, 4).astype(np.float64)
                    label = np.zeros(n, np.int64)
                    there = min(n, max(0, codes - at))  # points beyond a shorter label file have none
                    if there:
                        with files.open_input_file(label_path(scan)) as side:
                            label[:there] = np.frombuffer(side.read_at(there * CODE, at * CODE), "<u4")
                    yield pa.RecordBatch.from_arrays([pa.repeat(scan, n), pa.repeat(sequence_of(scan), n), pa.array(np.arange(at, at + n)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T], pa.array(label)], ["path", "sequence", "point_id", "x", "y", "z", "intensity", "label"])


def sequence_of(scan: str) -> str:
    """The name of the folder that holds a scan's ``velodyne`` folder, or the scan's own folder."""
    folders = scan.split("/")[:-1]
    return ("", *folders)[-2 if folders[-1:] == ["velodyne"] and len(folders) > 1 else -1]


class LidarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxmill_lidar"

    def schema(self) -> str:
        return "path string, sequence string, point_id bigint, x double, y double, z double, intensity double, label bigint"

    def reader(self, schema: object) -> LidarReader:
        return LidarReader(self.options)


class SegmentReader(DataSourceReader):
    """Reads the numbers of the arrays ``segIndices`` as a stream: never more than a step of a file is held.

    A file holds one scene or, object after object, many; a scene is named by the ``sceneId`` before its array.
    """

    KEY = re.compile(rb'"segIndices"\s*:\s*\[')
    SCENE = re.compile(rb'"sceneId"\s*:\s*("(?:[^"\\]|\\.)*")')

    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.step = options["path"], options.get("suffix", ".json"), int(options.get("step", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, n in listed(self.path, (self.suffix,)):
            if held and size + n + OPEN > SPLIT:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, 0, n, -1))
            size += n + OPEN
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        held, rows = [], 0
        for path, _, _, _ in partition.parts:
            with files.open_input_stream(path) as stream:
                for scene, at, numbers in segment_arrays(stream, self.step):
                    held.append((path, scene, at, numbers))
                    rows += len(numbers)
                    if rows >= BATCH:
                        yield segment_batch(held)
                        held, rows = [], 0
        if held:
            yield segment_batch(held)


def segment_batch(held: list[tuple[str, str | None, int, np.ndarray]]) -> pa.RecordBatch:
    """One batch of runs of numbers: (path, scene, position of the first, numbers)."""
    paths, scenes, firsts, runs = zip(*held)
    run = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in runs]))
    places = np.concatenate([np.arange(at, at + len(x)) for at, x in zip(firsts, runs)])
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()).take(run), pa.array(scenes, pa.string()).take(run), pa.array(places), pa.array(np.concatenate(runs))], ["path", "scene", "point_id", "segment"])


def segment_arrays(stream: pa.NativeFile, step: int) -> Iterator[tuple[str | None, int, np.ndarray]]:
    """(scene, position of the first, numbers) of every array, step by step; nothing if the key is not there."""
    held, scene, at, inside = b"", None, 0, False
    while True:
        data = stream.read(step)
        held, pos = held + data, 0
        while True:
            if not inside:
                m = SegmentReader.KEY.search(held, pos)
                name = SegmentReader.SCENE.search(held, pos, m.start() if m else len(held))
                if name:
                    scene = json.loads(name[1])
                if m is None:
                    pos = begun(held, max(pos, name.end() if name else 0))
                    break
                inside, at, pos = True, 0, m.end()
            end = held.find(b"]", pos)
            cut = end if end >= 0 else held.rfind(b",", pos)
            if cut >= 0:
                whole, pos = held[pos:cut], cut + 1
                if whole.strip():
                    numbers = np.fromstring(whole.decode("ascii"), np.int64, sep=",")
                    yield scene, at, numbers
                    at += len(numbers)
            if end < 0:
                break
            inside, scene = False, None
        held = held[pos:]
        if not data:
            if inside:
                raise ValueError("the array segIndices does not end")
            return


def begun(held: bytes, pos: int) -> int:
    """Where a key or a scene's name may have begun that more bytes complete, with any white space in it."""
    key, scene = held.rfind(b'"segIndices"', pos), held.rfind(b'"sceneId"', pos)
    if scene >= 0 and key < scene and re.fullmatch(rb'\s*(:\s*("(?:[^"\\]|\\.)*\\?)?)?', held[scene + 9 :]):
        return scene
    return key if key >= 0 and not held[key + 12 :].strip(b" \t\r\n:") else max(pos, len(held) - 12)


def segment_numbers(stream: pa.NativeFile, step: int) -> Iterator[np.ndarray]:
    """The numbers of all arrays, step by step."""
    return (numbers for _, _, numbers in segment_arrays(stream, step))


class SegmentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxmill_segments"

    def schema(self) -> str:
        return "path string, scene string, point_id bigint, segment bigint"

    def reader(self, schema: object) -> SegmentReader:
        return SegmentReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, final path) of the files of a task."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Writes rows (path, content) as files below a folder."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        done = []
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    part = f"{root}/{self.hidden}/{uuid.uuid4().hex}"
                    files.create_dir(f"{root}/{self.hidden}", recursive=True)
                    done.append((part, f"{root}/{path.lstrip('/')}"))
                    with files.open_output_stream(part) as out:
                        out.write(content.as_buffer() if content.is_valid else b"")
        except BaseException:
            for part, _ in done:
                if files.get_file_info(part).is_file:
                    files.delete_file(part)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        for part, path in (x for m in messages if m for x in m.files):
            files.create_dir(path.rpartition("/")[0], recursive=True)
            files.move(part, path)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Drop the temporary folder, with what failed and repeated tasks left in it."""
        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.hidden}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxmill_files"

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def read_store(spark: SparkSession, source: type[DataSource], path: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)
