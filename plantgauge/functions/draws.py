"""Reproducible draws from md5, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_text(*parts) -> Column:
    """The parts joined by '|'; plain values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    return F.md5(key_text(*parts))


def number(*parts) -> Column:
    """An integer in [0, 2^32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A double in [0, 1)."""
    return number(*parts) / F.lit(4294967296.0)


def index(n: Column, *parts) -> Column:
    """An integer in [0, n)."""
    return F.pmod(number(*parts), n)
