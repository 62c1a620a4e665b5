"""Seeded pseudo-random orders and numbers that any engine with md5 reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_order(seed: int | str, *ids: Column) -> Column:
    """A string whose order is the order of the draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def uniform(seed: int | str, *ids: Column) -> Column:
    """A number in [0, 1): the first 8 hex digits of the md5 over 2 ** 32."""
    return F.conv(F.substring(draw_order(seed, *ids), 1, 8), 16, 10).cast("double") / float(1 << 32)
