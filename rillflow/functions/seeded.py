"""Random choices that depend on keys and a seed alone: the same in every run, every partitioning and every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(key: Column | str) -> Column:
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))


def order(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits to sort by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *map(_text, keys)).cast("binary"))


def unit(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) of 52 bits."""
    return F.conv(F.substring(order(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
