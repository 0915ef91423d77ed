"""The durable segment state machine on snapshots: each transition maps a table of segments to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import intervals, upsert
from threadloom.sources.schemas import FAILURE_CLASSES, SEGMENT_STATUSES

NUMBERED = 10_000_000


def checks() -> dict[str, Column]:
    return {
        "start_before_end": F.col("start_id") <= F.col("end_id"),
        "attempts_not_negative": F.col("attempts") >= 0,
        "unresolved_not_negative": F.col("unresolved_count") >= 0,
        "status_known": F.col("status").isin(*SEGMENT_STATUSES),
        "failure_class_known": F.col("failure_class").isin(*FAILURE_CLASSES),
    }


def by_status(segments: DataFrame, status: str, limit: int) -> DataFrame:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return segments.filter(F.col("status") == status).orderBy("start_id", "segment_id").limit(limit)


def pending_in_window(segments: DataFrame, start: int, end: int) -> DataFrame:
    return intervals.overlapping(segments.filter(F.col("status") == "pending"), start, end)


def enqueue(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments and new pending ones for the ranges, numbered on from the largest segment_id in order of start.

    Numbers are dealt in two steps: how many ranges each ``NUMBERED``-wide stretch of ids holds, then the order inside a stretch, so only one row a stretch is ordered globally.
    """
    top = segments.agg(F.coalesce(F.max("segment_id"), F.lit(0)).alias("top"))
    placed = ranges.withColumn("stretch", F.floor(F.col("start_id") / NUMBERED))
    before = F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select("stretch", before.alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("stretch").orderBy("start_id", "end_id"))
    new = placed.join(offsets, "stretch").withColumn("nth", nth).join(F.broadcast(top), F.lit(True)).select((F.col("top") + F.col("nth")).cast("long").alias("segment_id"), "start_id", "end_id")
    filled = {"status": F.lit("pending"), "attempts": F.lit(0), "unresolved_count": (F.col("end_id") - F.col("start_id") + 1).cast("int")}
    new = new.withColumns(filled)
    return segments.unionByName(new, allowMissingColumns=True)


def _set(segments: DataFrame, where: Column, **values: Column) -> DataFrame:
    return segments.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(segments.schema[c].dataType) for c, v in values.items()})


def _no_error() -> dict[str, Column]:
    return {"last_error": F.lit(None), "failure_class": F.lit(None)}


def claim_next(segments: DataFrame) -> DataFrame:
    """The next pending segment (any window) as it is once claimed; no row if none is pending."""
    top = segments.filter(F.col("status") == "pending").orderBy("start_id", "segment_id").limit(1)
    return _set(top, F.lit(True), status=F.lit("in_progress"), attempts=F.col("attempts") + 1, **_no_error())


def requeue(segments: DataFrame, status: str) -> DataFrame:
    """in_progress (after a crash) or retry_wait (at the next run) back to pending; cursors stay."""
    return _set(segments, F.col("status") == status, status=F.lit("pending"))


def set_pending(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The segments of ``chosen(segment_id)`` are pending again without an error; cursors and counts stay."""
    none = chosen.select("segment_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("failure_class"))
    return upsert.update_from(segments, none, "segment_id", ["status", "last_error", "failure_class"])


def update_progress(segments: DataFrame, progress: DataFrame) -> DataFrame:
    """Cursor (null clears it) and count from ``progress(segment_id, scan_cursor_id, unresolved_count)``; a negative count is an error."""
    count = F.when(F.col("unresolved_count") < 0, F.raise_error("unresolved_count must not be negative").cast("int")).otherwise(F.col("unresolved_count"))
    return upsert.update_from(segments, progress.withColumn("unresolved_count", count), "segment_id", ["scan_cursor_id", "unresolved_count"])


def reset_window(segments: DataFrame, exceptions: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """All segments that touch the window start over, and so do their exceptions."""
    hit = (F.col("end_id") >= start) & (F.col("start_id") <= end)
    touched = segments.filter(hit).select("segment_id").withColumn("_hit", F.lit(True))
    whole = (F.col("end_id") - F.col("start_id") + 1).cast("int")
    after = _set(segments, hit, status=F.lit("pending"), scan_cursor_id=F.lit(None), unresolved_count=whole, **_no_error())
    own = exceptions.join(touched, "segment_id", "left")
    own = _set(own, F.col("_hit").isNotNull(), state=F.lit("pending"), attempts=F.lit(0), **_no_error()).drop("_hit")
    return after, own.select(*exceptions.columns)


def apply_results(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments after attempts: ``results(segment_id, outcome, last_durable_id, error, error_class)``, outcome done, retry_wait or dead_letter."""
    r = results.select(F.col("segment_id").alias("_id"), "outcome", "last_durable_id", "error", "error_class")
    joined = segments.join(r, F.col("segment_id") == F.col("_id"), "left")
    hit, done = F.col("outcome").isNotNull(), F.col("outcome") == "done"
    last = F.col("last_durable_id")
    left = F.when(done, F.lit(0)).otherwise(F.greatest(F.col("end_id") - F.coalesce(last + 1, F.col("start_id")) + 1, F.lit(0)))
    after = _set(joined, hit, status=F.col("outcome"), scan_cursor_id=F.when(done, F.col("end_id")).otherwise(F.coalesce(last, F.col("scan_cursor_id"))), unresolved_count=left, last_error=F.when(~done, F.col("error")), failure_class=F.when(~done, F.col("error_class")))
    return after.select(*segments.columns)


def prepare(segments: DataFrame, target_max: int, width: int, cold_start: int | None = None) -> tuple[int, DataFrame]:
    """(first id of the plan, pending (segment_id, start_id, end_id) of the window) after requeueing and filling holes.

    Every status counts as coverage, so dead letters block a new segment for their ids and hold the frontier back.
    """
    if target_max <= 0 or width <= 0 or (cold_start is not None and cold_start <= 0):
        raise ValueError("target, width and cold start must be positive")
    state = requeue(requeue(segments, "in_progress"), "retry_wait")
    reached = intervals.frontier(state.filter("status = 'done'")).first()[0]
    start = cold_start if cold_start is not None else reached + 1
    holes = intervals.split_ranges(intervals.uncovered(state, start, target_max), width)
    return start, pending_in_window(enqueue(state, holes), start, target_max).select("segment_id", "start_id", "end_id")


def run_report(segments: DataFrame, results: DataFrame, target_max: int, width: int, cold_start: int | None = None) -> DataFrame:
    """One row: what a catchup run found, planned and did, from the segments before it and the ``results(segment_id, outcome)`` of those it claimed.

    The frontier is that of the plan, before anything was claimed. A dead letter is a fatal failure.
    """
    was = lambda status: F.count_if(F.col("status") == status)
    requeued, reactivated = segments.agg(was("in_progress"), was("retry_wait")).first()
    reached = intervals.frontier(segments.filter("status = 'done'")).first()[0]
    start = cold_start if cold_start is not None else reached + 1
    created = intervals.split_ranges(intervals.uncovered(segments, start, target_max), width).count()
    ended = lambda outcome: F.count_if(F.col("outcome") == outcome)
    numbers = [F.lit(x).cast("long") for x in (reached, start, target_max, created)]
    names = ("frontier_id", "planning_start_id", "target_max_id", "created_segments")
    return results.agg(
        *(x.alias(name) for x, name in zip(numbers, names, strict=True)), F.count(F.lit(1)).alias("claimed_segments"), ended("done").alias("completed_segments"), ended("retry_wait").alias("retry_wait_segments"),
        ended("dead_letter").alias("dead_letter_segments"), F.lit(requeued).alias("requeued_in_progress"), F.lit(reactivated).alias("reactivated_retry_wait"), (ended("dead_letter") > 0).alias("had_fatal_failures"),
    )


def run_summary(segments: DataFrame) -> DataFrame:
    n = lambda status: F.count_if(F.col("status") == status)
    return segments.agg(n("done").alias("n_done"), n("retry_wait").alias("n_retry_wait"), n("dead_letter").alias("n_dead_letter"), n("pending").alias("n_pending"), F.coalesce(F.sum("unresolved_count"), F.lit(0)).alias("n_unresolved"))
