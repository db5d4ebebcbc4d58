"""Morton keys and small vector arithmetic as Column expressions.

Bit i of x goes to bit 3i+2 of the key, y to 3i+1, z to 3i. Coordinates are cut towards zero and
masked to ``depth`` bits (16 at most). A cloud id is a column of its own; packed keys, with the
cloud in the bits from 48 up, are for output only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift and mask of each step that spreads 16 bits to every third place.
SPREAD = ((16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249))

BATCH_BIT = 48


def bits(n: int) -> Column:
    return F.lit(n).cast("long")


def steps(depth: int) -> list[tuple[int, int]]:
    """The spreading steps that values of ``depth`` bits need: each halves the runs of bits."""
    return [(shift, keep) for shift, keep in SPREAD if shift < 2 * depth or shift == 2]


def spread(v: Column, depth: int = 16) -> Column:
    for shift, keep in steps(depth):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(bits(keep))
    return v


def gather(v: Column, depth: int = 16) -> Column:
    taken = steps(depth)
    v = v.bitwiseAND(bits(SPREAD[-1][1]))
    for (shift, _), keep in zip(taken[::-1], [k for _, k in taken[-2::-1]] + [0xFFFF]):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(bits(keep))
    return v.bitwiseAND(bits((1 << depth) - 1))


def xyz_to_key(x: Column, y: Column, z: Column, depth: int) -> Column:
    parts = [F.shiftleft(spread(c.cast("long").bitwiseAND(bits((1 << depth) - 1)), depth), s) for c, s in ((x, 2), (y, 1), (z, 0))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def key_to_xyz(key: Column, depth: int = 16) -> tuple[Column, Column, Column]:
    return tuple(gather(F.shiftright(key, s), depth) for s in (2, 1, 0))


def axis_steps(key: Column, axis: int, depth: int, wrap: bool = False) -> list[Column]:
    """The key's bits of one axis (0 x, 1 y, 2 z) one cell back, as they are, and one cell on.

    Beyond the cube they are null or, with ``wrap``, those of the far side.

    Works on the spread bits themselves: the other axes' bits carry the addition across.
    """
    unit = 4 >> axis
    mask = sum(unit << 3 * i for i in range(depth))
    own = key.bitwiseAND(bits(mask))
    back, on = (own - bits(unit)).bitwiseAND(bits(mask)), (own.bitwiseOR(bits(~mask)) + bits(unit)).bitwiseAND(bits(mask))
    return [back, own, on] if wrap else [F.when(own != 0, back), own, F.when(own != mask, on)]


def pack_key(cloud: Column, key: Column) -> Column:
    return F.shiftleft(cloud.cast("long"), BATCH_BIT).bitwiseOR(key)


def unpack_key(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, BATCH_BIT), packed.bitwiseAND(bits((1 << BATCH_BIT) - 1))


def parent(key: Column, levels: int = 1) -> Column:
    return F.shiftright(key, 3 * levels)


def norm(*v: Column) -> Column:
    total = v[0] * v[0]
    for c in v[1:]:
        total = total + c * c
    return F.sqrt(total)


def normalized(*v: Column, least: float = 1e-12) -> list[Column]:
    length = F.greatest(norm(*v), F.lit(least))
    return [c / length for c in v]


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform in [0, 1) from md5 of ``seed:part:...``; any engine with md5 gives the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def vector_sum(name: str, channels: int) -> Column:
    """Sums an array column of known width element by element, with partial aggregation."""
    return F.array(*[F.sum(F.col(name)[k]) for k in range(channels)])


def vector_avg(name: str, channels: int) -> Column:
    return F.array(*[F.avg(F.col(name)[k]) for k in range(channels)])


def zeros(channels: int, value: float = 0.0) -> Column:
    return F.array(*[F.lit(float(value))] * channels)
