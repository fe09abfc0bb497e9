"""Random numbers that depend on a key alone, so that any partitioning and any retry draws the same.

The draw is the first 52 bits of the MD5 of the key's text. For releases that must stay private the key has to
include a secret; a public seed makes results reproducible and nothing else.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1 << 52


def key_text(*parts: Column | str | int) -> Column:
    """The parts' texts joined by |; nulls count as a sign of their own."""
    texts = [
        F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts
    ]
    return F.concat_ws("|", *texts)


def bits(*parts: Column | str | int) -> Column:
    """A whole number from 0 to 2^52 - 1."""
    return F.conv(F.substring(F.md5(key_text(*parts)), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1)."""
    return bits(*parts) / F.lit(float(_STEPS))


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal, by Box and Muller from two uniforms of the key."""
    first = (bits("g1", *parts) + 1) / F.lit(float(_STEPS + 1))
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2 * math.pi) * uniform("g2", *parts))


def gaussian_value(*parts: str | int) -> float:
    """The same draw as `gaussian` for a key known on the driver."""

    def take(purpose: str) -> int:
        return int(hashlib.md5("|".join(map(str, (purpose, *parts))).encode()).hexdigest()[:13], 16)

    return math.sqrt(-2.0 * math.log((take("g1") + 1) / (_STEPS + 1))) * math.cos(2 * math.pi * (take("g2") / _STEPS))


def bits_sql(key: str) -> str:
    """`bits` as DuckDB SQL; `key` is an expression of the key's text."""
    return f"cast('0x' || substr(md5({key}), 1, 13) as bigint)"


def uniform_sql(key: str) -> str:
    return f"({bits_sql(key)} / {float(_STEPS)!r})"


def gaussian_sql(key: str) -> str:
    """The same draw as DuckDB SQL; `key` is an expression of the key's text behind its first part."""
    take = "cast('0x' || substr(md5({0}), 1, 13) as bigint)"
    first = take.format(f"'g1|' || {key}")
    second = take.format(f"'g2|' || {key}")
    return (
        f"(sqrt(-2.0 * ln(({first} + 1) / {float(_STEPS + 1)!r}))"
        f" * cos({2 * math.pi!r} * ({second} / {float(_STEPS)!r})))"
    )
