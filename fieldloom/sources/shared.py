"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set and all runs on one machine (as in tests), a temporary one is set; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A name of a new folder in the shared one."""
    return f"{shared_dir(spark)}/fieldloom-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df as a written table over all cores: a small file is read by one task or a few, however much work each of its rows makes. A shuffle alone
    would not do, as filters on what is computed afterwards move below it."""
    return written(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism))


def written(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: computed once, and nothing to compute again if an executor is lost."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
