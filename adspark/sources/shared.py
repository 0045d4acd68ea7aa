"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions.

    The folder must be one that all executors share; a path without a scheme, or with ``file:``, may
    be a mounted share, so it is taken as it is.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="adspark-")
    return _LOCAL[application]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the planner the real size,
    so that later joins broadcast it only when it is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table in this many splits or more is read as it is; fewer splits hold a few GB at most.
FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out to more tasks, up to ``FEW_SPLITS`` or what the session runs.

    Small files hold few bytes but may stand for much work (redraws, levels, pairs). Only tables of
    few splits are shuffled, however many cores there are.
    """
    tasks = min(FEW_SPLITS, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
