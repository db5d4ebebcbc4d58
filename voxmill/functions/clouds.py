"""Points meet what is known of their cloud (a box, a matrix, parameters) without being moved for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.ranks import free
from voxmill.staging import kept

#: Rows of a table of clouds that are broadcast, at most: some 50 MB with a dozen numbers each.
CLOUDS = 200_000
#: Parts that each cloud is cut into where there are more.
PARTS = 32


def meet(points: DataFrame, table: DataFrame, by: tuple[str, ...] = ("cloud_id",), how: str = "inner", most: int | None = None) -> DataFrame:
    """``points`` joined with ``table``, which has one row for each ``by``.

    The table is worked out once, kept, and counted. Up to ``most`` rows (CLOUDS) it is broadcast, and no point moves. With more, points are dealt
    by cloud and one of PARTS parts, which are hashes of their coordinates, and meet a copy of the table's row in each: a cloud with a third of all
    points is that many tasks. Streams are joined as they are.
    """
    if points.isStreaming or table.isStreaming:
        return points.join(table, list(by), how)
    table = kept(table)
    if table.count() <= (CLOUDS if most is None else most):
        return points.join(F.broadcast(table), list(by), how)
    (part,) = free(points, "part")
    dealt = points.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in "xyz"]), F.lit(PARTS)))
    copies = table.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [*by, part], how).drop(part)
