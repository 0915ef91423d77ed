"""Full-table export in shards of equal size, and its job state."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.ordering import BITS
from threadloom.sources.scratch import Scratch

SHARD_BYTES = 5 * 10**9


def row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row's values in memory: fixed widths, contents of strings and binaries, and 4 bytes of place for each of those and each array."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(value).cast("long") + 4
        if isinstance(kind, T.ArrayType):
            return F.aggregate(F.transform(value, lambda x: F.coalesce(of(x, kind.elementType), F.lit(0).cast("long"))), F.lit(4).cast("long"), lambda a, x: a + x)
        if isinstance(kind, T.StructType):
            return reduce(lambda a, b: a + b, (F.coalesce(of(value[f.name], f.dataType), F.lit(0).cast("long")) for f in kind.fields), F.lit(0).cast("long"))
        width = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}.get(type(kind), 8)
        return F.lit(width).cast("long")

    return reduce(lambda a, b: a + b, (F.coalesce(of(F.col(f.name), f.dataType), F.lit(0).cast("long")) for f in schema.fields), F.lit(0).cast("long"))


@dataclass
class Exported:
    rows: int
    bytes: int
    shards: int


def export(table: DataFrame, path: str, order: list[str], shard_bytes: int = SHARD_BYTES, dry_run: bool = False) -> Exported:
    """Writes the table as Parquet, one file a shard in folders ``shard=K``, and says what it holds; a dry run only says it.

    Shards are stretches of the table in the order given, all of the same number of bytes (to a row), ``shard_bytes`` at most. The table is scanned once: the
    sort writes it down with each row's bytes, and a shard follows from the bytes of the sort's tasks before it and those before the row in its own.
    """
    scratch = Scratch(table.sparkSession)
    sized = table.withColumn("_bytes", row_bytes(table.schema))
    if dry_run:
        rows, size = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
        return Exported(rows, size, -(-size // shard_bytes))
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table("placed", placed.withColumn("_task", F.shiftright("_at", BITS)))
    tasks = sorted(placed.groupBy("_task").agg(F.count(F.lit(1)), F.sum("_bytes")).collect())
    rows, size = sum(t[1] for t in tasks), sum(t[2] for t in tasks)
    shards = -(-size // shard_bytes)
    if not rows:
        table.limit(0).write.mode("overwrite").parquet(path)
        return Exported(0, 0, 0)
    before = [(t[0], end - t[2]) for t, end in zip(tasks, accumulate(t[2] for t in tasks), strict=True)]
    offsets = F.broadcast(table.sparkSession.createDataFrame(before, "_task long, _before long"))
    inside = F.sum("_bytes").over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_before") + F.coalesce(inside, F.lit(0))
    dealt = placed.join(offsets, "_task").withColumn("shard", F.floor(start.cast("decimal(38,0)") * shards / size).cast("int"))
    dealt.repartition("shard").sortWithinPartitions("_at").drop("_bytes", "_at", "_task", "_before").write.mode("overwrite").partitionBy("shard").parquet(path)
    scratch.clear()
    return Exported(rows, size, shards)


@dataclass
class ExportJob:
    """idle -> running -> finished or failed. One run at a time."""

    state: str = "idle"
    error: str | None = None

    def run(self, tables: dict[str, tuple[DataFrame, list[str]]], root: str, dry_run: bool = False, shard_bytes: int = SHARD_BYTES) -> dict[str, Exported]:
        """Exports each (table, order) to its folder below root."""
        if self.state == "running":
            raise RuntimeError("an export is running")
        self.state, self.error = "running", None
        try:
            done = {name: export(df, f"{root}/{name}", order, shard_bytes, dry_run) for name, (df, order) in tables.items()}
        except Exception as error:
            self.state, self.error = "failed", str(error)
            raise
        self.state = "finished"
        return done
