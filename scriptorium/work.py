"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove a query's shuffle files at its end.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an input per core up to which its rows are dealt out evenly.
SMALL_BYTES = 8 << 20


def evenly(rows: DataFrame) -> DataFrame:
    """Deals out the rows of a small input evenly: a file of one row group is one task, however many cores there are.

    Larger inputs have row groups enough, and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= cores * SMALL_BYTES else rows


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only where neither is set (tests on a local master) a temporary folder is made and set.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (had := context._jsc.sc().getCheckpointDir()).isDefined():
        found = had.get()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


class WorkFolder:
    """A folder of one operator's run below the shared root.

    Parts are dropped as soon as they have served; the rest, such as a result, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.fs().mkdirs(self.hadoop())
        self.fs().deleteOnExit(self.hadoop())

    def hadoop(self, part: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)

    def fs(self):
        return self.hadoop().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, part: str) -> str:
        """The URI of a sub-folder for files that executors write, see :func:`write_blob`."""
        self.fs().mkdirs(self.hadoop(part))
        return f"{self.path}/{part}"

    def table(self, df: DataFrame, part: str) -> DataFrame:
        """Writes a table and reads it back: cuts the lineage, survives lost executors.

        The shuffle files of the write, which may be several times the result, go as soon as it is done.
        """
        conf = self.spark.conf
        had = conf.get(FILES_GO, None)
        conf.set(FILES_GO, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{part}")
        finally:
            conf.unset(FILES_GO) if had is None else conf.set(FILES_GO, had)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{part}")

    def drop(self, *parts: str) -> None:
        for part in parts:
            self.fs().delete(self.hadoop(part), True)
