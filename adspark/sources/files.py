"""Readers and writers: delimited endpoint files, split files, partitioned bundles, result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.joining import join_on


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Delimited file(s) with a header and an explicit schema."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def path_fields(pattern_by_name: dict[str, str], path: Column | None = None) -> list[Column]:
    """Columns taken from the file path, one regular expression with one group each."""
    path = F.col("_metadata.file_path") if path is None else path
    return [
        F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias(name)
        for name, pattern in pattern_by_name.items()
    ]


def read_with_path_fields(spark: SparkSession, path: str, schema, pattern_by_name: dict[str, str]) -> DataFrame:
    """All delimited files below a folder, with metadata parsed from their names."""
    files = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    )
    return files.select("*", *path_fields(pattern_by_name))


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """One folder per combination of the partition columns, with files of about ``rows_per_file`` rows.

    A value that holds most rows is written by many tasks, one that holds few by a single one.
    """
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    cut = join_on(df, sizes, by)
    part = F.pmod(F.xxhash64(*df.columns), F.col("_files"))
    dealt = cut.repartition(*by, part).drop("_files")
    dealt.write.partitionBy(*by).format(fmt).option("header", True).option("maxRecordsPerFile", rows_per_file).save(path)


def read_bundle(spark: SparkSession, path: str, schema=None, **chosen) -> DataFrame:
    """Model-ready bundle; the chosen partition values prune the folders that are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    for name, value in chosen.items():
        df = df.where(F.col(name) == value)
    return df


def apply_split_table(rows: DataFrame, split: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Join a split table (fold, row_id, role); validation rows count as training rows."""
    role = F.when(F.col("role") == "val", F.lit("train")).otherwise(F.col("role"))
    return rows.join(split, row_id).withColumn("role", role)
