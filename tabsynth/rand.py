"""Draws that depend on a seed and a row's key alone, so that they don't change with partitions, retries or engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, keys: list[str | Column], number: int | str | Column = 0) -> Column:
    """An integer from 0 below 2^32: eight hex digits of an MD5."""
    number = number if isinstance(number, Column) else F.lit(str(number))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, keys: list[str | Column], number: int | str | Column = 0) -> Column:
    """From 0 to below 1."""
    return draw(seed, keys, number) / F.lit(2.0**32)
