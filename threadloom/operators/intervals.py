"""Coverage of a numeric id space by intervals.

Sweeps are running maxima over sorted starts. They are two-level: a maximum per bucket of starts, a running maximum over the
(few) buckets, and a running maximum inside each bucket, so that no task sorts all intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1_000_000


def enqueue_range(start: int, end: int, width: int, spark) -> DataFrame:
    """(start_id, end_id): fixed-width pieces of start..end, the last one clipped; empty if start > end."""
    if width <= 0:
        raise ValueError("segment width must be positive")
    starts = spark.range(start, end + 1, width) if start <= end else spark.range(0)
    return starts.select(F.col("id").alias("start_id"), F.least(F.col("id") + width - 1, F.lit(end)).alias("end_id"))


def split_ranges(ranges: DataFrame, width: int) -> DataFrame:
    """Each (start_id, end_id) cut into pieces of the width, as enqueue_range does for one."""
    starts = F.explode(F.sequence("start_id", "end_id", F.lit(width).cast("long")))
    return ranges.filter("start_id <= end_id").select("end_id", starts.alias("s")).select(F.col("s").alias("start_id"), F.least(F.col("s") + width - 1, F.col("end_id")).alias("end_id"))


def reached_before(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``reached``: the largest end among intervals that sort before this one by (start, end), or null."""
    rows = ranges.withColumn("_b", F.expr(f"start_id div {bucket}"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_b").agg(F.max("end_id").alias("_top")).withColumn("_earlier", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy("_b").orderBy("start_id", "end_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.max("end_id").over(inside)).join(tops, "_b").withColumn("reached", F.greatest("_own", "_earlier")).drop("_b", "_own", "_earlier")


def frontier(done: DataFrame) -> DataFrame:
    """One row (frontier): the largest id up to which done intervals cover everything from 1; 0 if none."""
    swept = reached_before(done.select("start_id", "end_id"))
    holes = swept.filter(F.col("start_id") > F.coalesce("reached", F.lit(0)) + 1).agg(F.min("start_id").alias("hole"))
    covered = done.join(F.broadcast(holes), F.col("hole").isNull() | (F.col("start_id") < F.col("hole")))  # one row
    return covered.agg(F.greatest(F.coalesce(F.max("end_id"), F.lit(0)), F.lit(0)).alias("frontier"))


def uncovered(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """(start_id, end_id) of the holes that intervals leave in start..end."""
    inside = ranges.filter((F.col("end_id") >= start) & (F.col("start_id") <= end)).select("start_id", "end_id")
    swept = reached_before(inside)
    low = F.greatest(F.coalesce(F.col("reached"), F.lit(start - 1)), F.lit(start - 1)) + 1
    holes = swept.select(low.alias("lo"), (F.col("start_id") - 1).alias("hi"))
    tail = inside.agg(F.max("end_id").alias("m")).select((F.greatest(F.coalesce("m", F.lit(start - 1)), F.lit(start - 1)) + 1).alias("lo"), F.lit(end).cast("long").alias("hi"))
    return holes.unionByName(tail).filter("lo <= hi").select(F.col("lo").alias("start_id"), F.col("hi").alias("end_id"))


def missing_ranges(ids: DataFrame, bucket: int = BUCKET, legacy_expand: bool = False) -> DataFrame:
    """(start_id, end_id) between consecutive ids (from 0) that are absent. Lag inside a bucket, stitched at its first id."""
    rows = ids.select("id").withColumn("_b", F.expr(f"id div {bucket}"))
    tops = rows.groupBy("_b").agg(F.max("id").alias("_top"))
    tops = tops.withColumn("_last", F.lag("_top").over(Window.orderBy("_b"))).drop("_top")
    lagged = rows.withColumn("_prev", F.lag("id").over(Window.partitionBy("_b").orderBy("id"))).join(tops, "_b")
    start = F.coalesce("_prev", "_last", F.lit(0)) + 1
    gaps = lagged.select(start.alias("start_id"), (F.col("id") - 1).alias("end_id")).filter("start_id <= end_id")
    return gaps.select((F.col("start_id") - 1).alias("start_id"), (F.col("end_id") + 1).alias("end_id")) if legacy_expand else gaps


def overlapping(rows: DataFrame, start: int, end: int) -> DataFrame:
    return rows.filter((F.col("end_id") >= start) & (F.col("start_id") <= end))
