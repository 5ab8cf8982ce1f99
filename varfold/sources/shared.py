"""The folder that driver and executors share, and the tables that are written to it on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own in local mode where it is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="varfold-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``drop_tables`` deletes."""
    path = f"{shared_dir(spark)}/varfold/{name}-{uuid.uuid4().hex}"
    SharedTable.written.append(path)
    return path


class SharedTable:
    """A DataFrame written as Parquet to the shared folder: its lineage ends there, and lost executors cost nothing."""

    #: Paths of this process's tables and folders that are still there.
    written: list[str] = []

    def __init__(self, df: DataFrame, name: str) -> None:
        self._spark = df.sparkSession
        self.path = shared_path(self._spark, name)
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files. Only call this when no DataFrame that reads them is still to run."""
        _delete(self._spark, self.path)
        SharedTable.written.remove(self.path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_tables(spark: SparkSession) -> int:
    """Delete all that this process has written on the way, once results that read it have been stored. Gives the number of tables and folders."""
    paths, SharedTable.written[:] = list(SharedTable.written), []
    for path in paths:
        _delete(spark, path)
    return len(paths)
