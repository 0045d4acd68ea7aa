"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.shared import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# tables that grow with the scale factor and feed row-multiplying operators
LARGE = {"lineitem", "orders", "events", "documents", "embeddings"}

DIGITS = 6


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.events`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in LARGE else df


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a few decimals, so that two engines print the same values."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType == T.DoubleType() else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, ctes: list[str] | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query. ``doubles`` lists the twin's double columns (rounded on both sides)."""

    def register(build: Callable[[Tables], DataFrame]):
        text = None
        if sql is not None:
            body = f"SELECT * FROM ({sql}) AS _q"
            if doubles:
                swaps = ", ".join(
                    f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles.split()
                )
                body = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS _q"
            text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, lambda t: rounded(build(t), digits), text)
        return build

    return register


def load_all() -> dict[str, Query]:
    """Import every module with registered queries."""
    from . import cleaning, domain, intervals, joins, missing_keys, modelling, reporting, scanning, shifts, splitting, statistics  # noqa: F401

    return REGISTRY
