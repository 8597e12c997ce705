"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where it is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="baseloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class _Cleaning:
    """Tells Spark to delete the shuffle files of a query as soon as it ends, while any table of the session is written."""

    def __init__(self):
        self.lock, self.writers, self.before = threading.Lock(), 0, "false"

    @contextmanager
    def on(self, conf):
        with self.lock:
            if not self.writers:
                self.before = conf.get(CLEANUP, "false")
                conf.set(CLEANUP, "true")
            self.writers += 1
        try:
            yield
        finally:
            with self.lock:
                self.writers -= 1
                if not self.writers:
                    conf.set(CLEANUP, self.before)


_CLEANING = _Cleaning()


class Scratch:
    """Writes tables to cut lineage and reads them back.

    A written table survives the loss of an executor.  What results may still read is
    deleted when the driver's JVM ends, all else by ``drop``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/baseloom-{uuid.uuid4().hex}"
        self.count = 0

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, codec: str = "zstd", **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with _CLEANING.on(self.spark.conf):
            df.write.options(compression=codec, **options).parquet(path)
        if self.count == 1:
            folder, fs = self._folder(self.root)
            fs.deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for root in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            folder, fs = self._folder(root)
            fs.delete(folder, True)
