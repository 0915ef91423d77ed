"""Structured log lines: reading them, keeping the units of interest, and the counters and gauges that they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the units whose lines are kept; the pattern covers the whole name.
KEPT_UNITS = r"^(?:(?:catchup-worker-.+|backfill-.+)\.service)$"
LINE = "timestamp string, level string, event string, run_id string, segment_id long, pending_segments long, progress_percent long, span struct<run_id: string>"
#: Counter name and the event that raises it.
COUNTED = {"claimed": "segment_claimed", "completed": "segment_completed", "retry_wait": "segment_retry_wait", "dead_letter": "segment_dead_letter"}


def read(lines: DataFrame) -> DataFrame:
    """(unit, seq, t, level, event, run_id, and the known fields) of ``lines(unit, seq, line)``, t in unix seconds.

    The run is named by the line or else by its span. Unknown fields go; a line that is not JSON keeps unit and seq, all else null.
    """
    parsed = lines.withColumn("x", F.from_json("line", LINE))
    known = (F.col(f"x.{c}").alias(c) for c in ("segment_id", "pending_segments", "progress_percent"))
    t = F.unix_seconds(F.try_to_timestamp("x.timestamp"))
    return parsed.select("unit", "seq", t.alias("t"), "x.level", "x.event", F.coalesce("x.run_id", "x.span.run_id").alias("run_id"), *known)


def kept(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("unit").rlike(KEPT_UNITS))


def counters(log: DataFrame, step: int = 60) -> DataFrame:
    """(run_id, t, and each counter of ``COUNTED``) for each step in which a run counts anything.

    Lines are added up by run and step on the map side, so the running sums order one row a step, however busy a run is.
    """
    raised = log.filter(F.col("event").isin(*COUNTED.values()) & F.col("t").isNotNull())
    steps = raised.groupBy("run_id", (F.col("t") - F.col("t") % step).alias("t")).agg(*(F.count_if(F.col("event") == e).alias(c) for c, e in COUNTED.items()))
    so_far = Window.partitionBy("run_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("run_id", "t", *(F.sum(c).over(so_far).alias(c) for c in COUNTED))


def gauges(log: DataFrame) -> DataFrame:
    """The last value of each gauge of a run, by time and then by seq."""
    names = ("pending_segments", "progress_percent")
    set_ = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t", "seq"))).alias(c)
    return log.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(*map(set_, names))


def realtime_counters(pulls: DataFrame, every: int) -> DataFrame:
    """(window, n_batches, largest, records_pulled, records_failed) from ``pulls(batch_id, ok)``, one row an id pulled; each id counts once."""
    batches = pulls.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("ok").alias("ok"))
    return batches.groupBy(F.floor(F.col("batch_id") / every).alias("window")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.max("size").alias("largest"), F.sum("ok").alias("records_pulled"), F.sum(F.col("size") - F.col("ok")).alias("records_failed")
    )
