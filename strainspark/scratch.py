"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back: the files survive the loss of any executor.  Where the session sets no
such folder (tests on one machine), a local folder is used instead.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local folder if the session runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or f"file:///tmp/checkpoints/strainspark-{os.getpid()}").rstrip("/")


class Scratch:
    """A folder of intermediate tables of one operator call.

    ``keep`` writes a table and returns it as read back; ``drop`` deletes tables
    no later step reads.  What a lazy result still reads stays until the
    interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # Once the table is written, nothing reads the shuffle files that led to it.
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEAN_UP, before) if before is not None else self.spark.conf.unset(CLEAN_UP)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
