"""Positions in one long list, by two steps instead of one window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, block: Column, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: each row's position (from 0) in ``order``, within ``by`` if given.

    ``block`` cuts the list into pieces of bounded size: it must not decrease along ``order``. Pieces are counted, the
    counts are summed up (one row a piece), and rows are numbered inside their piece, by as many tasks as there are pieces.
    """
    by = by or []
    piece, n, at, start, within, *others = free(df, "piece", "n", "at", "start", "within", *[f"by_{c}" for c in by])
    blocked = df.withColumn(piece, block)
    counts = blocked.groupBy(*by, piece).agg(F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(o) for c, o in zip(by, others)], F.col(piece).alias(at), F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(start))
    inside = Window.partitionBy(*by, piece).orderBy(*order)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, others)] + [F.col(piece).eqNullSafe(F.col(at))]
    placed = blocked.withColumn(within, F.row_number().over(inside)).join(starts, same)
    return placed.select(*df.columns, (F.col(start) + F.col(within) - 1).alias(name))


def running_sum(df: DataFrame, value: str, block: Column, order: list[Column], by: list[str] | None = None, exclusive: bool = False, name: str = "total") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows up to this one, by the same two steps.

    With ``exclusive`` the row itself does not count, and each list gets one more row, at its end: all columns but ``by`` are
    null there, and ``name`` is the sum of everything.
    """
    by = by or []
    piece, total, at, start, within, *others = free(df, "piece", "total", "at", "start", "within", *[f"by_{c}" for c in by])
    blocked = df.withColumn(piece, block)
    sums = blocked.groupBy(*by, piece).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(df.schema[value].dataType)
    starts = sums.select(*[F.col(c).alias(o) for c, o in zip(by, others)], F.col(piece).alias(at), F.coalesce(F.sum(total).over(before), zero).alias(start))
    inside = Window.partitionBy(*by, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, others)] + [F.col(piece).eqNullSafe(F.col(at))]
    placed = blocked.withColumn(within, F.coalesce(F.sum(value).over(inside), zero)).join(starts, same)
    out = placed.select(*df.columns, (F.col(start) + F.col(within)).alias(name))
    if not exclusive:
        return out
    ends = sums.groupBy(*by).agg(F.coalesce(F.sum(total), zero).alias(name))
    return out.unionByName(ends, allowMissingColumns=True)
