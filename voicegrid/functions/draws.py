"""Seeded draws from md5, so that any engine with md5 draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(tag: str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(tag), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def uniform32(tag: str, *parts: Column | str) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(digest(tag, *parts), 1, 8), 16, 10).cast("long")


def integer(lo: Column | int, hi: Column | int, tag: str, *parts: Column | str) -> Column:
    """A whole number from lo to hi, both included."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return lo + uniform32(tag, *parts) % (hi - lo + 1)


def bernoulli(p: float, tag: str, *parts: Column | str) -> Column:
    return uniform32(tag, *parts) < F.lit(int(p * (1 << 32)))
