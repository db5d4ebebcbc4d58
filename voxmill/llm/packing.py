"""Packing documents into sequences of bounded length by linear grouping.

A document's tokens and its end mark are one piece, or several if there are more than ``capacity``: then the first piece may
be shorter and all others are full. Full pieces are sequences of their own. The other *large* pieces are put in order of
length and cut into ``groups`` groups of equal cardinality; each counts as long as the longest of its group. Configurations
of these few sizes are chosen by subset sums: each takes the largest size that is left, fills up as far as it can, and is used as
often as the groups allow. Then the actual pieces take the places of their group, so sequences have room for what
was rounded up, and the *small* pieces are put where they fit best, longest first.

Plans need only counts: how many pieces have each length, and how many sequences have each room (``capacity`` numbers, whatever
the data's size). They say which ranks go where, by arithmetic; ranks within a length or a room are taken in two
steps over blocks of about ``BLOCK`` rows. So pieces are dealt by hash, however common a length is, and no list of pieces
goes through the driver or one task; a sequence holds at most ``capacity`` pieces.

A null text counts as empty: a piece that holds the end mark alone. Null ids and repeated rows are packed as they are;
long texts are cut into any number of pieces; ties in length are broken by hash; an empty table gives an empty result. Other columns than the id
and the text are not read and may have any names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.functions.ranks import ranked
from voxmill.llm.common import Steps, staged
from voxmill.llm.vocab import ByteLevel

#: Rows of a block of ranks, about.
BLOCK = 4096
#: Bytes of ids sent on at once.
SENT = 4 << 20


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevel:
    return ByteLevel(path)


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int = 1024, text: str = "text") -> DataFrame:
    """row (a number for each document), doc_id, piece (from 0), start (tokens before it), length and ids (unsigned 32-bit, little-endian)."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "piece", "start", "length", "ids"]
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at, piece, start, ids, size = [], [], [], [], 0
            for k, x in enumerate(batch.column(2)):
                whole = own.ids(x.as_py() or "") + last
                n = len(whole) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for p, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    at.append(k)
                    piece.append(p)
                    start.append(i)
                    ids.append(whole[4 * i : 4 * j])
                size += len(whole)
                if size >= SENT or k == batch.num_rows - 1:
                    kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names)
                    at, piece, start, ids, size = [], [], [], [], 0

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row bigint, doc_id {id_kind}, piece int, start bigint, length bigint, ids binary")


def best_sum(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size (largest first) to take so that the sum is as near to ``capacity`` as it can be, larger ones first."""
    mask = (1 << (capacity + 1)) - 1
    sums, taken = 1, [1]
    steps = []
    for k, (size, count) in enumerate(zip(sizes, counts)):
        left, chunk = min(count, capacity // size), 1
        while left > 0:  # any number up to count as a sum of powers of two and a rest
            n = min(chunk, left)
            steps.append((k, n))
            sums |= (sums << (n * size)) & mask
            taken.append(sums)
            left, chunk = left - n, chunk * 2
        if sums >> capacity & 1:
            break
    out, at = [0] * len(sizes), sums.bit_length() - 1
    for (k, n), before in zip(steps[::-1], taken[-2::-1]):
        if not before >> at & 1:
            out[k] += n
            at -= n * sizes[k]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, how many such sequences) that use up all counts. Sizes are in falling order."""
    counts, out = list(counts), []
    while any(counts):
        first = next(k for k, n in enumerate(counts) if n)
        left = counts.copy()
        left[first] -= 1
        one = best_sum(sizes, left, capacity - sizes[first]) if sizes[first] < capacity else [0] * len(sizes)
        one[first] += 1
        times = min(n // c for n, c in zip(counts, one) if c)
        counts = [n - c * times for n, c in zip(counts, one)]
        out.append((one, times))
    return out


def group_bounds(lengths: list[tuple[int, int]], groups: int) -> tuple[list[int], list[int], int]:
    """Sizes and counts of groups of equal cardinality over (length, count) in falling order, and that cardinality."""
    total = sum(n for _, n in lengths)
    share = max(1, -(-total // groups))
    sizes, before = [], 0
    for length, n in lengths:
        while len(sizes) * share < before + n:  # the longest of a group is its first
            sizes.append(length)
        before += n
    return sizes, [min(share, total - k * share) for k in range(len(sizes))], share


def best_fit(rooms: dict[int, int], lengths: list[tuple[int, int]], capacity: int) -> list[tuple]:
    """Where (length, count) in falling order go: rows (length, first rank, ranks, in one sequence, room, first sequence of that room).

    ``rooms`` says how many sequences have each room. As best fit does one piece at a time, a sequence is filled with a length while there is room,
    tightest ones first. Room -1 stands for new sequences, numbered from 0.
    """
    held = {room: [(room, 0, n)] for room, n in rooms.items() if n and room > 0}  # room now: (room at first, first sequence, sequences)
    fresh, out = 0, []
    for length, left in lengths:
        rank = 0
        while left:
            now = min((r for r in held if r >= length), default=None)
            if now is None:
                n = -(-left // (capacity // length))
                held[capacity] = [(-1, fresh, n)]
                fresh, now = fresh + n, capacity
            runs, each = held.pop(now), now // length
            while runs and left:
                room, first, n = runs.pop()
                full = min(n, left // each)
                if full:
                    out.append((length, rank, full * each, each, room, first))
                    held.setdefault(now - each * length, []).append((room, first, full))
                    rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
                if n and left:  # one more sequence takes what is left, fewer than ``each``
                    out.append((length, rank, left, left, room, first))
                    held.setdefault(now - left * length, []).append((room, first, 1))
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    runs.append((room, first, n))
            if runs:
                held.setdefault(now, []).extend(runs)
    return out


def pack(pieces: DataFrame, capacity: int = 1024, groups: int = 256, small: int | None = None) -> DataFrame:
    """``pieces`` (of them ``row``, ``piece`` and ``length``, from 1 to capacity, are read) with sequence_id and offset.

    Pieces of ``small`` tokens or fewer (an eighth of the capacity if not given) are put in last.
    """
    spark, steps = pieces.sparkSession, Steps(pieces.sparkSession)
    small = capacity // 8 if small is None else small
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    blocks = max(1, sum(lengths.values()) // BLOCK)
    carried = pieces.select("row", "piece", "length", F.struct(*pieces.columns).alias("whole"))
    dealt = ranked(carried, F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)), [F.col("row"), F.col("piece")], by=["length"])
    dealt = steps.write("ranks", dealt)

    # large pieces take the places of configurations
    order = [(size, lengths[size]) for size in sorted(lengths, reverse=True) if small < size < capacity]
    sizes, counts, share = group_bounds(order, groups)
    places, sequence, used = [], lengths.get(capacity, 0), [0] * len(sizes)
    for one, times in configurations(sizes, counts, capacity):
        for k, c in enumerate(one):
            if c:
                places.append((k, used[k], used[k] + c * times, c, sequence))
                used[k] += c * times
        sequence += times
    before, starts = 0, []
    for size, n in order:
        starts.append((size, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "length bigint, before bigint"))  # capacity rows at most
    places = F.broadcast(spark.createDataFrame(places, "grp bigint, place bigint, upto bigint, each bigint, first bigint"))  # fewer than groups ** 2
    full = dealt.where(F.col("length") == capacity).select(*dealt.columns, F.col("rank").alias("sequence_id"))
    large = dealt.join(starts, "length").withColumn("at", F.col("before") + F.col("rank"))
    large = large.select(*dealt.columns, F.expr(f"at div {share}").alias("grp"), (F.col("at") % share).alias("at"))
    large = large.join(places, (large["grp"] == places["grp"]) & (F.col("at") >= F.col("place")) & (F.col("at") < F.col("upto")))
    large = large.select(*dealt.columns, F.expr("first + (at - place) div each").alias("sequence_id"))
    placed = steps.write("placed", full.unionByName(large))

    # the rooms that are left, and the small pieces in them
    rooms = placed.where(F.col("length") < capacity).groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))
    rooms = steps.write("rooms", ranked(rooms, F.expr(f"sequence_id div {BLOCK}"), [F.col("sequence_id")], by=["room"], name="nth"))
    free = {r.room: r.n for r in rooms.groupBy("room").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    fits = best_fit(free, [(size, lengths[size]) for size in sorted(lengths, reverse=True) if size <= small], capacity)
    fits = F.broadcast(spark.createDataFrame(fits, "size bigint, place bigint, n bigint, each bigint, room bigint, first bigint"))  # some rows a length and a room
    rest = dealt.join(fits, (dealt["length"] == fits["size"]) & (F.col("rank") >= F.col("place")) & (F.col("rank") < F.col("place") + F.col("n")))
    rest = rest.select(*dealt.columns, "room", F.expr("first + (rank - place) div each").alias("nth"))
    fresh = rest.where("room = -1").select(*dealt.columns, (F.lit(sequence) + F.col("nth")).alias("sequence_id"))
    met = rest.where("room >= 0").join(rooms, ["room", "nth"]).select(*dealt.columns, "sequence_id")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")).alias("offset")
    return placed.unionByName(met).unionByName(fresh).select("whole.*", F.col("sequence_id").cast("long").alias("sequence_id"), offset)


def pack_documents(docs: DataFrame, path: str, end: int, capacity: int = 1024, ids: bool = True) -> DataFrame:
    """Every piece with its place; with ``ids`` the pieces' tokens, else their CRC-32 only (as ids_crc32)."""
    pieces = token_pieces(docs, path, end, capacity)
    if not ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = pack(staged(pieces, "pieces"), capacity)
    return packed.drop("row")
