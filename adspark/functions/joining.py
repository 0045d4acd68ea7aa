"""Joins on keys that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys equal each other; the keys appear once, as with a list of names.

    ``how``: inner, left, left_semi or left_anti. Grouping keeps a NULL key as a group of its own, so
    what is computed per group must be joined back this way, or the rows of that group are lost.
    """
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_key_{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{k}" for k in keys])
