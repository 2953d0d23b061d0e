"""Durable intermediate tables in the folder that driver and executors share, and tables spread over the cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text table below this many bytes a core is dealt out anew, as its few row groups would leave cores idle.
SPREAD_BYTES = 4_000_000

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors share a disk, may do without: it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_root:
        _own_root[key] = tempfile.mkdtemp(prefix="caselight-")
    return _own_root[key]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/caselight/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table dealt out by ``key``, one part a core; a large one, whose files feed all cores, as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, F.col(key)) if size < cores * SPREAD_BYTES else df
