"""Randomness by key: the same number from the same key in any engine, order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """The first 52 bits of the key's SHA-256 as a number in [0, 1): every one has a double of its own."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def draw(key: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(key) * n).cast("long")


def uniform_sql(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
