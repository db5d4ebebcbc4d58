"""Chroma fingerprints of recordings, and their alignment.

A recording (16-bit mono samples) becomes pitch-class frames: twelve sums of spectral power, scaled
to length one. Sixteen filters compare areas of the frames in a window of ``SPAN`` frames;
areas come from one integral image, whatever their size. Each comparison is cut to two bits,
so that a window is a packed 32-bit integer; a window in which nothing sounds has none (null). Two recordings are
aligned by the offset at which most of their integers agree, and accepted if the share of differing bits over what
sounds in the overlap is small; where only one of them sounds, all bits differ.

An integer that holds on (a tone) gives one vote, at its start, and silence gives none, so neither is met window by
window. Integers at many places are dealt to parts on both sides, so that no task meets more than SPOTS by SPOTS places.

Recordings with the same integers are one class, so copies are compared once; links are counted
for classes and given to all members. Null, empty or too short samples give no integers and align
with nothing. Repeated rows come back as often as they came in; null ids never are queries. A recording is one row, however long, and is
worked on whole. Other columns are not read and may have any names; empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import join_hot, staged

FRAME, HOP, SPAN = 1024, 256, 16
LOW_HZ, HIGH_HZ = 80.0, 3000.0
#: Cuts of a comparison (a log ratio of areas) into two bits, in Gray code.
CUTS = (-0.15, 0.0, 0.15)
#: An alignment needs so many equal integers, an overlap of so many, and at most so many differing bits.
VOTES, OVERLAP, ERRORS = 3, 16, 0.2
#: Places of one integer that are met in one task, on either side.
SPOTS = 4096


@lru_cache(maxsize=8)
def pitch_classes(rate: int) -> np.ndarray:
    """Spectrum bins (rows) to pitch classes (columns)."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), 12))
    heard = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[heard, np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12] = 1
    return out


def chroma(pcm: bytes | None, rate: int) -> np.ndarray:
    """Frames by pitch class, each of length one or, if silent, zero."""
    samples = np.frombuffer(pcm or b"", "<i2", len(pcm or b"") // 2).astype(np.float64) / 32768
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    bands = power @ pitch_classes(rate)
    size = np.linalg.norm(bands, axis=1, keepdims=True)
    return np.where(size > 1e-6, bands / np.maximum(size, 1e-6), 0)


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first frame, frames, first class, classes): a fixed bank made by rule."""
    return [(k % 5, (k * 3) % 5, 8 + 4 * (k % 2), (k * 5) % 7, 4 + 2 * (k % 2)) for k in range(16)]


def fingerprint(pcm: bytes | None, rate: int) -> np.ndarray:
    """One packed integer (int32) for every window of SPAN frames."""
    return packed_windows(chroma(pcm, rate))


def heard(image: np.ndarray) -> np.ndarray:
    """For every window of SPAN frames whether anything sounds in it."""
    sounding = np.r_[0, np.cumsum(image.any(1))]
    return sounding[SPAN:] > sounding[:-SPAN]


def windows(pcm: bytes | None, rate: int) -> list[int | None]:
    """The integers of a recording, None for silent windows."""
    image = chroma(pcm, rate)
    return [x if on else None for x, on in zip(packed_windows(image).tolist(), heard(image).tolist())]


def packed_windows(image: np.ndarray) -> np.ndarray:
    """Windows of frames to integers."""
    n = len(image) - SPAN + 1
    if n < 1:
        return np.empty(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        return total[x + w : x + w + n, y + h] - total[x : x + n, y + h] - total[x + w : x + w + n, y] + total[x : x + n, y]

    out = np.zeros(n, np.uint32)
    for kind, x, w, y, h in filters():
        whole = area(x, w, y, h)
        if kind == 0:  # lower against upper classes
            a = area(x, w, y, h // 2)
        elif kind == 1:  # earlier against later frames
            a = area(x, w // 2, y, h)
        elif kind == 2:  # one diagonal against the other
            a = area(x, w // 2, y, h // 2) + area(x + w // 2, w // 2, y + h // 2, h // 2)
        elif kind == 3:  # the middle frames against the outer ones
            a = area(x + w // 4, w // 2, y, h)
        else:  # the middle classes against the outer ones
            a = area(x, w, y + h // 4, h // 2)
        level = np.digitize(np.round(np.log((1 + a) / (1 + whole - a)), 9), CUTS)  # rounded: equal areas are equal in any window
        level = level.astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out.view(np.int32)


def fingerprints(recordings: DataFrame) -> DataFrame:
    """rec_id and ``prints`` (array of int) of recordings (rec_id, pcm, rate).

    Samples are large and the work on each is long, so they are sent row by row, never in batches of thousands.
    """
    prints = F.udf(lambda pcm, rate: windows(pcm, 8000 if rate is None else rate), "array<int>", useArrow=False)
    return recordings.select("rec_id", prints("pcm", "rate").alias("prints"))


def align(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Accepted alignments of ``queries`` (query_id, prints) with ``classes`` (class_id, prints).

    query_id, class_id, offset (of the query's start in the recording, in frames), votes, error_rate.
    """
    asked, held = staged(starts(queries, "query_id", "q_at"), "asked"), staged(starts(classes, "class_id", "c_at"), "held")
    sizes = [side.groupBy("print").agg(F.ceil(F.count("*") / SPOTS).alias(n)) for side, n in ((asked, "q_parts"), (held, "c_parts"))]
    counts = sizes[0].join(sizes[1], "print")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = asked.join(counts, "print").select("query_id", "q_at", "print", F.pmod(F.xxhash64("query_id", "q_at"), F.col("q_parts")).alias("q_part"), numbers("c_parts").alias("c_part"))
    held = held.join(counts, "print").select("class_id", "c_at", "print", numbers("q_parts").alias("q_part"), F.pmod(F.xxhash64("class_id", "c_at"), F.col("c_parts")).alias("c_part"))
    met = held.join(asked, ["print", "q_part", "c_part"])
    votes = met.groupBy("query_id", "class_id", (F.col("c_at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.where(F.col("votes") >= VOTES).groupBy("query_id", "class_id").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.abs("offset"), "offset")).alias("best"))
    best = best.select("query_id", "class_id", "best.offset", "best.votes")
    both = best.join(queries.withColumnRenamed("prints", "q"), "query_id").join(classes.withColumnRenamed("prints", "c"), "class_id")
    start, skip = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    length = F.least(F.size("c") - start, F.size("q") - skip)
    both = both.withColumn("length", length).where(F.col("length") >= OVERLAP)
    differ = lambda a, b: F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), 32).otherwise(F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF))))
    bits = F.filter(F.zip_with(F.slice("c", start + 1, F.col("length")), F.slice("q", skip + 1, F.col("length")), differ), lambda x: x.isNotNull())
    both = both.withColumn("bits", bits).where(F.size("bits") >= OVERLAP)
    error = F.aggregate("bits", F.lit(0), lambda s, x: s + x) / (32.0 * F.size("bits"))
    return both.withColumn("error_rate", error).where(F.col("error_rate") <= ERRORS).select("query_id", "class_id", "offset", "votes", "error_rate")


def starts(rows: DataFrame, name: str, at: str) -> DataFrame:
    """(``name``, ``at``, print): where integers start to hold in ``prints``."""
    each = F.transform("prints", lambda x, k: F.struct(k.alias(at), x.alias("print"), F.when(k > 0, F.get("prints", k - 1)).alias("before")))
    first = F.filter(each, lambda x: x["print"].isNotNull() & ~x["print"].eqNullSafe(x["before"]))
    return rows.select(name, F.explode(first).alias("x")).select(name, f"x.{at}", "x.print")


def digest(prints: str) -> F.Column:
    """Equal for equal lists of integers."""
    return F.sha2(F.array_join(F.col(prints).cast("array<string>"), ",", "-"), 256)


def search(recordings: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Every recording with its class and how the ``excerpts`` (query recordings) align with it.

    rec_id, n_prints, class_id (smallest id with the same integers), n_links (queries aligned), and
    the best one's best_query, best_offset, votes and error_rate (null without links).
    """
    prints = staged(fingerprints(recordings).withColumn("digest", digest("prints")), "prints")
    classes = staged(prints.where(F.size("prints") > 0).groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.any_value("prints").alias("prints"), F.count("*").alias("n")), "classes")
    # excerpts of the same integers are one query, which counts as often as there are ids
    told = fingerprints(excerpts.where(F.col("rec_id").isNotNull())).withColumn("digest", digest("prints"))
    ids = told.groupBy("rec_id").agg(F.min(F.struct("digest", "prints")).alias("x")).select("rec_id", "x.*")
    asked = staged(ids.where(F.size("prints") > 0).groupBy("digest").agg(F.min("rec_id").alias("query_id"), F.any_value("prints").alias("prints"), F.count("*").alias("asked")), "queries")
    found = align(asked.select("query_id", "prints"), classes.where("class_id is not null").select("class_id", "prints")).join(asked.select("query_id", "asked"), "query_id")
    links = found.groupBy("class_id").agg(F.sum("asked").alias("n_links"), F.min_by(F.struct(F.col("query_id").alias("best_query"), F.col("offset").alias("best_offset"), "votes", "error_rate"), F.struct("error_rate", -F.col("votes"), "query_id")).alias("best"))
    told = staged(classes.join(links, "class_id", "left").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.*", "n"), "told")
    named = join_hot(prints.select("rec_id", "digest", F.size("prints").cast("long").alias("n_prints")).where("n_prints > 0"), told, "digest")
    silent = prints.where(F.size("prints") == 0).select("rec_id", F.lit(0).cast("long").alias("n_prints"), F.col("rec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.drop("digest").unionByName(silent, allowMissingColumns=True)


def sound(vector: list[float] | None, rate: int = 8000, note: int = 512) -> np.ndarray | None:
    """Samples in which each value of the vector sounds as a note for ``note`` samples."""
    if not vector:
        return None
    time, edge = np.arange(note) / rate, np.arange(note)
    pitch = np.floor(np.nan_to_num(np.array([0.0 if v is None else v for v in vector], np.float64)) * 96) % 24
    wave = np.sin(2 * np.pi * 220 * 2 ** (pitch[:, None] / 12) * time) * np.minimum(1, np.minimum(edge, edge[::-1]) / 32)
    return np.round(wave.ravel() * 16000).astype("<i2")


def excerpt(samples: np.ndarray | None) -> np.ndarray | None:
    """The middle of a recording, off the frame raster, with faint noise."""
    if samples is None:
        return None
    some = samples[len(samples) // 5 + 37 : len(samples) * 4 // 5]
    return (some + (np.arange(len(some)) * 7919 % 401 - 200).astype("<i2")).astype("<i2")


def played(vectors: DataFrame, part: bool = False) -> DataFrame:
    """Recordings (rec_id, rate, pcm) derived from vectors (vec_id, embedding); with ``part`` their excerpts."""

    def make(vector: list[float] | None) -> bytes | None:
        samples = excerpt(sound(vector)) if part else sound(vector)
        return None if samples is None else samples.tobytes()

    return vectors.select(F.col("vec_id").alias("rec_id"), F.lit(8000).alias("rate"), F.udf(make, "binary", useArrow=False)("embedding").alias("pcm"))
