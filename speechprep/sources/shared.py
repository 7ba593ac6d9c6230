"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where a local session sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="speechprep-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """The path, and the file system that it is on, as Hadoop's API gives them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times (milliseconds) of what lies in a folder."""
    where, files = hadoop(spark, path)
    return [(x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(where)] if files.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    where, files = hadoop(spark, path)
    files.delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and once, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
