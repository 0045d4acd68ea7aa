"""What the document operators share."""

from __future__ import annotations

import contextlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import shared_folder

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments cuts at just these.
SPACE = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as a job's result is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet, in the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text as an array, none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of a text are in a regular expression's class (NULL: none)."""
    return (F.size(F.split(F.coalesce(text, F.lit("")), characters, -1)) - 1).cast("long")


def parts(rows: int, least: int, per_part: int) -> int:
    """Number of partitions for so many rows."""
    return max(least, math.ceil(rows / per_part))
