"""Folders for tables that outlive a job, in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def folder(spark: SparkSession, ending: str = "") -> str:
    """Name of a new folder below ``spark.checkpoint.dir`` (a local session may name none), gone when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sparktok-")
    path = f"{shared.rstrip('/')}/sparktok-{uuid.uuid4().hex}{ending}"
    system, there = _path(spark, path)
    system.deleteOnExit(there)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, there = _path(spark, path)
    system.delete(there, True)
