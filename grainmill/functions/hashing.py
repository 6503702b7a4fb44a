"""Deterministic draws from keys: the same key gives the same priority in any process, order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^63: priorities are below it, and dividing by it gives a draw in [0, 1].
SPAN = 9223372036854775808.0


def priority(key: Column) -> Column:
    """SHA-256 of the key modulo 2^63. Null keys have none."""
    tail = F.conv(F.substring(F.sha2(key, 256), 49, 16), 16, -10).cast("long")
    return tail.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def draw(key: Column) -> Column:
    return draw_of(priority(key))


def draw_of(number: Column) -> Column:
    return number.cast("double") / F.lit(SPAN)


def shuffled(key: Column, seed: int = 42) -> Column:
    """A pseudo-random sort key; sort by it and then by the key itself."""
    return F.xxhash64(key, F.lit(seed))
