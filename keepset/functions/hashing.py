"""Repeatable randomness: every random choice is a function of a key and a seed.

``rand()`` depends on how rows fall into partitions; a hash of the row's key
does not, so results survive repartitioning and task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``; a repeatable shuffle order."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """A uniform double in (0, 1), never exactly 0 or 1, from 32 hash bits."""
    bits = F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def uniform_index(n: Column | int, *parts: Column | str | int) -> Column:
    """A uniform int in 0 .. n-1."""
    return F.floor(uniform(*parts) * n).cast("int")


def standard_normal(*parts: Column | str | int) -> Column:
    """A standard normal double: Box-Muller over two hash uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "radius")))
    angle = F.lit(6.283185307179586) * uniform(*parts, "angle")
    return radius * F.cos(angle)
