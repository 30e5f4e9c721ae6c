"""Tables written for the time of an operation, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a folder, and a cluster ValueError."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Written:
    """A frame written as Parquet: ``df`` reads it, ``bytes`` is its size, ``remove`` deletes it."""

    def __init__(self, df: DataFrame, folder: str | None = None) -> None:
        spark = df.sparkSession
        self.path = f"{folder or shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        sc = spark.sparkContext
        self._at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(sc._jsc.hadoopConfiguration())

    @property
    def bytes(self) -> int:
        return self._fs.getContentSummary(self._at).getLength()

    def remove(self) -> None:
        self._fs.delete(self._at, True)
