"""A table kept under a stream of changes, in buckets of its key, of which a batch rewrites only those that it touches.

A batch's folder holds new versions of the buckets with changed keys; a bucket is what the last batch that touched it wrote. Versions are added, never overwritten in place: a
batch that is lost half-way leaves no _SUCCESS and is not seen, and a batch that is replayed is made from what it was made from the first time. A version is deleted once two
later batches of its bucket exist. What the driver holds is the names of the buckets' versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.upsert import last_per_key, upsert
from threadloom.sources.scratch import Scratch


class Snapshot:
    def __init__(self, scratch: Scratch, name: str, schema, keys: Sequence[str], buckets: int = 64):
        """``buckets``: as many as make a bucket a task's work; it must not change while the table lives."""
        self.scratch, self.name, self.schema, self.keys, self.buckets = scratch, name, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, below: int | None = None) -> dict[int, list[int]]:
        """Batches that wrote each bucket, oldest first, of batches that are complete and below a number."""
        jvm = self.scratch.spark.sparkContext._jvm
        conf = self.scratch.spark.sparkContext._jsc.hadoopConfiguration()

        def names(pattern: str) -> list[tuple[str, str]]:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.scratch.path(self.name)}/{pattern}")
            found = where.getFileSystem(conf).globStatus(where) or []
            return [(x.getPath().getParent().getName(), x.getPath().getName()) for x in found]

        done = {folder for folder, _ in names("batch=*/_SUCCESS")}
        found: dict[int, list[int]] = {}
        for folder, bucket in names("batch=*/bucket=*"):
            batch = int(folder.removeprefix("batch="))
            if folder in done and (below is None or batch < below):
                found.setdefault(int(bucket.removeprefix("bucket=")), []).append(batch)
        return {bucket: sorted(batches) for bucket, batches in found.items()}

    def _path(self, batch: int, bucket: int) -> str:
        return self.scratch.path(f"{self.name}/batch={batch}/bucket={bucket}")

    def read(self, below: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or its buckets in ``only``."""
        spark = self.scratch.spark
        paths = [self._path(batches[-1], bucket) for bucket, batches in self.versions(below).items() if only is None or bucket in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def apply(self, rows: DataFrame, batch: int) -> list[int]:
        """Upserts rows, one for each key, as a numbered batch, and the buckets rewritten."""
        rows = self.scratch.table(f"{self.name}-rows", rows.select(*self.schema.names).withColumn("bucket", self.bucket()))
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
        if touched:
            old = self.read(batch, touched).withColumn("bucket", self.bucket())
            after = upsert(old, rows, [*self.keys, "bucket"]).repartition(len(touched), "bucket")
            after.write.mode("overwrite").partitionBy("bucket").parquet(self.scratch.path(f"{self.name}/batch={batch}"))
        for bucket, batches in self.versions().items():
            self.scratch.drop(*(f"{self.name}/batch={b}/bucket={bucket}" for b in batches[:-2]))
        return touched

    def follow(self, stream: DataFrame, order: Sequence[str]):
        """A writer that applies a stream batch by batch; within a batch the last change of a key in ``order`` wins."""

        def apply(rows: DataFrame, batch: int) -> None:
            self.apply(last_per_key(rows, self.keys, order), batch)

        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", self.scratch.path(f"{self.name}-progress"))
