"""Written intermediate tables in the folder that driver and executors share.

``Scratch`` cuts lineage by writing a DataFrame as Parquet below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs one
stage and not the whole plan.  Tables that are not handed to the caller are
deleted when the block ends; the kept ones go when the JVM ends.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Set while a block is open: shuffle files go when their job has ended, and Arrow batches
#: stay small, for a worker holds a few numpy arrays for each byte of a batch.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where a local session names none (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparktok-")
        _delete_on_exit(spark, found)
        spark.conf.set(CHECKPOINT_DIR, found)
    return found


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, there = _path(spark, path)
    fs.deleteOnExit(there)


class Scratch:
    """``with Scratch(spark) as s: t = s.stage(df); return s.keep(result)``.

    Every step ends in a written table, so no shuffle is read by a later one.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/sparktok-{uuid.uuid4().hex}"
        self.count = 0
        self.dropped: list[str] = []

    def __enter__(self) -> Scratch:
        self.before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *exc) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        for path in self.dropped:
            self.remove(path)

    @contextlib.contextmanager
    def splits(self, most: int) -> Iterator[None]:
        """Tables are read in splits of at most so many bytes, where each byte stands for much work."""
        key, before = "spark.sql.files.maxPartitionBytes", self.spark.conf.get("spark.sql.files.maxPartitionBytes")
        size = self.spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
        self.spark.conf.set(key, str(min(size, most)))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def write(self, df: DataFrame, keep: bool = False) -> str:
        self.count += 1
        path = f"{self.root}-{self.count}"
        _delete_on_exit(self.spark, path)
        df.write.option("compression", "zstd").parquet(path)
        if not keep:
            self.dropped.append(path)
        return path

    def stage(self, df: DataFrame) -> DataFrame:
        """Write now, read back; gone when the block ends."""
        return self.spark.read.parquet(self.write(df))

    def keep(self, df: DataFrame) -> DataFrame:
        """Write now, read back; stays until the JVM ends."""
        return self.spark.read.parquet(self.write(df, keep=True))

    def remove(self, path: str) -> None:
        fs, there = _path(self.spark, path)
        fs.delete(there, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that no later step reads."""
        files = df.inputFiles()
        for path in [p for p in self.dropped if files and f"/{p.rsplit('/', 1)[1]}/" in files[0]]:
            self.remove(path)
            self.dropped.remove(path)
