"""Counter series: rates over a sliding range with extrapolation to its edges, and ratios of rates; and the registry of a run's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import sizing

#: Fixed values of the extrapolation: how many average gaps an edge may be away to count as reached, and what part of a gap is added where it is not.
REACHED, PART = 1.1, 0.5


def extrapolated(first: Column, last: Column, increase: Column, t_first: Column, t_last: Column, n: Column, at: Column, seconds: int) -> Column:
    """Per-second rate over (at - seconds, at] from a range's first and last sample: the increase between them, stretched to the edges of the range that samples come
    near, and by half a gap at others, but never back to before the counter was zero. Null for fewer than two samples."""
    sampled = t_last - t_first
    gap = sampled / (n - 1)
    to_start, to_end = t_first - (at - seconds), at - t_last
    to_start = F.when(to_start >= gap * REACHED, gap * PART).otherwise(to_start)
    to_zero = sampled * (first / increase)
    to_start = F.when((increase > 0) & (first >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    to_end = F.when(to_end >= gap * REACHED, gap * PART).otherwise(to_end)
    return F.when((n >= 2) & (sampled > 0), increase * ((sampled + to_start + to_end) / sampled) / seconds)


def rate(samples: DataFrame, seconds: int = 300, step: int = 60, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(by..., t, rate): the rate of a counter ``value`` sampled at ``t`` (unix seconds), at each multiple of ``step`` whose range holds two samples.

    A fall of the counter is a reset, after which the new value is the increase. Samples are dealt by series and stretch of ``seconds``, with the stretch before, so that
    a long series is many groups; which sample comes before one matters only where both are in one range, and so in one stretch or two adjacent ones.
    """
    stretch = F.floor(F.col("t") / seconds)
    own = samples.select(*by, F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value")).withColumn("_own", stretch)
    near = own.withColumn("_in", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    before = F.lag("value").over(Window.partitionBy(*by, "_in").orderBy("t"))
    stepped = near.withColumn("_lost", F.when(before > F.col("value"), before).otherwise(0.0)).filter("_in = _own")
    first, last = F.ceil(F.col("t") / step) * step, (F.ceil((F.col("t") + seconds) / step) - 1) * step
    ranges = stepped.withColumn("_at", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))))
    seen = ranges.groupBy(*by, "_at").agg(
        F.min_by(F.struct("value", "_lost", "t"), "t").alias("a"), F.max_by(F.struct("value", "t"), "t").alias("b"), F.sum("_lost").alias("lost"), F.count(F.lit(1)).alias("n"),
    )
    increase = F.col("b.value") - F.col("a.value") + F.col("lost") - F.col("a._lost")  # what was lost before the first sample is not the range's
    found = extrapolated(F.col("a.value"), F.col("b.value"), increase, F.col("a.t"), F.col("b.t"), F.col("n"), F.col("_at"), seconds)
    return seen.select(*by, F.col("_at").alias("t"), found.alias("rate")).filter("rate IS NOT NULL")


def rate_ratio(above: DataFrame, below: DataFrame, on: tuple[str, ...], floor: float = 1.0) -> DataFrame:
    """The rates ``above`` with ``ratio`` to the rate ``below`` of equal ``on`` and t, which counts as ``floor`` at least; only where both are known."""
    both = above.join(below.select(*on, "t", F.col("rate").alias("_below")), [*on, "t"])
    return both.withColumn("ratio", F.col("rate") / F.greatest("_below", F.lit(floor))).drop("_below")


# The names under which metrics are read, counters and gauges of a catchup run and of the change stream.
CATCHUP_COUNTERS = ("segments_claimed", "segments_completed", "segments_retry_wait", "segments_dead_letter", "terminal_missing_items", "durable_items")
CATCHUP_GAUGES = ("frontier_id", "target_max_id", "pending_segments", "target_total_items", "durable_items_completed", "progress_percent", "target_is_full_history", "target_is_updater", "target_is_bounded")
REALTIME = {"batch_size": "gauge", "records_processed": "counter", "records_failed": "counter"}


def registry(report: DataFrame, attempts: DataFrame, pending: DataFrame, missing: DataFrame, profile: str, realtime: dict[str, int], build: dict[str, str]) -> DataFrame:
    """(metric, kind, labels, value): the 15 metrics of a catchup run, the 3 of the change stream, and build_info, which is 1.

    ``report`` is segments.run_report's row; ``attempts(segment_id, start_id, scan_cursor_id, last_durable_id)`` the claimed segments and the last id that each made durable;
    ``pending`` the segments of the plan; ``missing`` a row for each item found to be missing for good. With nothing pending all of the target counts as done.
    """
    advanced = sizing.durable_advance(sizing.next_id(F.col("start_id"), F.col("scan_cursor_id")), F.col("last_durable_id"))
    row, durable = report.first(), attempts.agg(F.coalesce(F.sum(advanced), F.lit(0))).first()[0]
    planned, total = pending.count(), max(row["target_max_id"] - row["planning_start_id"] + 1, 0)
    done = durable if planned else total
    values = {
        "segments_claimed": row["claimed_segments"], "segments_completed": row["completed_segments"], "segments_retry_wait": row["retry_wait_segments"], "segments_dead_letter": row["dead_letter_segments"],
        "terminal_missing_items": missing.count(), "durable_items": durable, "frontier_id": row["frontier_id"], "target_max_id": row["target_max_id"], "pending_segments": planned, "target_total_items": total,
        "durable_items_completed": done, "progress_percent": min(done, total) * 100 // total if total else 100,
    } | {f"target_is_{name}": int(profile == name) for name in ("full_history", "updater", "bounded")}
    rows = [(f"catchup_{n}_total", "counter", "", values[n]) for n in CATCHUP_COUNTERS] + [(f"catchup_{n}", "gauge", "", values[n]) for n in CATCHUP_GAUGES]
    rows += [(f"realtime_{n}" + "_total" * (kind == "counter"), kind, "", realtime[n]) for n, kind in REALTIME.items()]
    rows.append(("build_info", "gauge", ",".join(f'{k}="{v}"' for k, v in build.items()), 1))
    return report.sparkSession.createDataFrame(rows, "metric string, kind string, labels string, value long")
