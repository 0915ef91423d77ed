"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables in the shared folder named by spark.checkpoint.dir.

    Reading a written table back cuts the lineage, so a lost executor costs a reread and not the job. Only where
    the setting is absent, as in local tests, a temporary folder takes its place; a cluster without the setting
    is an error, because executors could not see each other's files. Tables go when the driver ends.
    """

    def __init__(self, spark: SparkSession, keep: str | None = None):
        """Tables of one run, or those of ``keep``, a name under which they outlive the driver and a later run finds them."""
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.gettempdir()
        self.root = f"{root.rstrip('/')}/threadloom-{keep or uuid.uuid4().hex}"
        if not keep:
            atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        self._delete(*map(self.path, names))

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
