"""Reproducible pseudo-random order keys.

Random splits are exact quotas over a hash order. ``md5`` gives the same order in any SQL
engine; ``xxhash64`` is several times cheaper and meant for very many redraws.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_key(parts: list, method: str = "md5") -> Column:
    """Hexadecimal order key of the given columns or literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if method == "md5":
        return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    if method == "xxhash64":
        return F.lpad(F.lower(F.hex(F.xxhash64(*cols))), 16, "0")
    raise ValueError(f"unknown hash method {method!r}")


def order_bucket(key: Column, digits: int = 4) -> Column:
    """Leading digits of an order key: buckets follow the order and hold equal shares."""
    return F.substring(key, 1, digits)
