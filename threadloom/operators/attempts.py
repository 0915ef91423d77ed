"""Outcomes of fetch attempts, folded by windows and aggregates instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import classify


def retry_outcome(statuses: Column, max_attempts: int) -> Column:
    """Struct (attempts, status, result) of an item whose n-th attempt gets the n-th status; an exhausted list means 200.

    Stops at the first status that is not retryable, or at max_attempts. result: found, fatal or retryable.
    """
    tried = F.transform(F.sequence(F.lit(1), F.lit(max(max_attempts, 1))), lambda k: F.struct(k.alias("n"), F.coalesce(F.get(statuses, k - 1), F.lit(200)).alias("status")))
    again = lambda s: F.coalesce(classify.is_retryable(classify.status_kind(s)), F.lit(False))
    stop = F.coalesce(F.get(F.filter(tried, lambda x: ~again(x["status"])), F.lit(0)), F.element_at(tried, -1))
    result = F.when(stop["status"].between(200, 299), "found").when(again(stop["status"]), "retryable").otherwise("fatal")
    return F.struct(stop["n"].cast("int").alias("attempts"), stop["status"].alias("status"), result.alias("result"))


def flush_outcome(n_items: Column, n_kids: Column, errors: Column, max_attempts: int) -> Column:
    """Struct (attempts, result, failure_class) of writing a batch whose n-th attempt ends in the n-th error, null or absent if it works.

    result: nothing (an empty batch), written, retryable (attempts exhausted) or fatal, as edges without items are before any attempt.
    """
    tried = F.transform(F.sequence(F.lit(1), F.lit(max(max_attempts, 1))), lambda k: F.struct(k.alias("n"), F.get(errors, k - 1).alias("error")))
    again = lambda x: x["error"].isNotNull() & (classify.persist_outcome(x["error"]) == "retryable")
    stop = F.coalesce(F.get(F.filter(tried, lambda x: ~again(x)), F.lit(0)), F.element_at(tried, -1))
    result = F.when(stop["error"].isNull(), "written").otherwise(classify.persist_outcome(stop["error"]))
    result = F.when(n_items > 0, result).when(n_kids > 0, "fatal").otherwise("nothing")
    failure = F.when(result == "retryable", "network_transient").when(result == "fatal", "schema")
    return F.struct(F.when(n_items > 0, stop["n"]).otherwise(0).cast("int").alias("attempts"), result.alias("result"), failure.alias("failure_class"))


def realtime_outcome(statuses: Column, has_body: Column, max_attempts: int) -> Column:
    """Struct (attempts, result, failure_class) of one item that a change stream names: as retry_outcome, but an item without a body is missing and success counts one attempt."""
    r = retry_outcome(statuses, max_attempts)
    found = r["result"] == "found"
    result = F.when(found & has_body, "succeeded").when(found, "missing").otherwise(r["result"])
    return F.struct(F.when(found & has_body, 1).otherwise(r["attempts"]).alias("attempts"), result.alias("result"), F.when(~found, classify.status_class(r["status"])).alias("failure_class"))


STRETCH = 10_000


def segment_attempts(work: DataFrame, items: DataFrame, batch_size: int) -> DataFrame:
    """One row per segment of ``work(segment_id, start_id, end_id, scan_cursor_id)`` from ``items(id, result)``.

    result: found, missing, retryable or fatal; an id without a row is missing. Ids are walked in order up to the first failure. The last
    durable id moves to each id at which a full batch is flushed and to each missing id; a failure leaves it where it was, and a
    clean end moves it to end_id. A batch restarts after a flush, so its fill is the number of found ids since the last missing one, modulo the size.

    Ids without a row are counted, not listed: a segment is cut into pieces as wide as itself, to a power of two, at most ``STRETCH``, and items are dealt to pieces of the widths
    in use (fifteen at most). A piece gives its first failure, its found ids before that, and its last missing one. The last durable id follows from the last missing id before a segment's first
    failure, since all ids from there to the failure, or the end, are found. So a segment of any width is many tasks, and one row a piece is brought together by segment. Ids of items are unique.
    """
    size, whole = max(batch_size, 1), ["segment_id", "start_id", "end_id", "scan_cursor_id"]
    first = F.when(F.col("scan_cursor_id").isNull() | (F.col("scan_cursor_id") < F.col("start_id")), F.col("start_id")).otherwise(F.col("scan_cursor_id") + 1)
    started = work.select(*whole, first.alias("next_id"))
    step = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.col("end_id") - F.col("next_id") + 1))).cast("long"), F.lit(STRETCH).cast("long"))
    base = lambda c: F.col(c) - F.pmod(F.col(c), F.col("_step"))
    cut = started.filter("next_id <= end_id").withColumn("_step", step)
    steps = sorted(r[0] for r in cut.select("_step").distinct().collect())
    cut = cut.withColumn("_base", F.explode(F.sequence(base("next_id"), base("end_id"), F.col("_step"))))
    cut = cut.withColumn("_low", F.greatest("next_id", "_base")).withColumn("_high", F.least(F.col("end_id"), F.col("_base") + F.col("_step") - 1))
    dealt = items.filter(F.col("result").isin("found", "retryable", "fatal")).select("id", "result", F.explode(F.array(*(F.lit(x) for x in steps)).cast("array<bigint>")).alias("_step"))
    dealt = dealt.withColumn("_base", base("id"))
    met = cut.join(dealt, (cut["_step"] == dealt["_step"]) & (cut["_base"] == dealt["_base"]) & F.col("id").between(F.col("_low"), F.col("_high")), "left").drop(dealt["_step"]).drop(dealt["_base"])
    failed = F.col("result").isin("retryable", "fatal")
    pieces = met.groupBy(*whole, "next_id", "_step", "_base", "_low", "_high").agg(
        F.array_sort(F.collect_set(F.when(~failed, F.col("id")))).alias("_found"), F.min(F.when(failed, F.struct("id", "result"))).alias("_end")
    )
    pieces = pieces.withColumn("_last", F.coalesce(F.col("_end.id") - 1, F.col("_high")))
    pieces = pieces.withColumn("_found", F.filter("_found", lambda x: x <= F.col("_last"))).withColumn("_n", F.size("_found").cast("long"))
    run = F.size(F.filter("_found", lambda x, i: x + F.col("_n") - 1 - i == F.col("_last")))  # found ids without a gap up to the last
    missing = F.col("_last") - F.col("_low") + 1 - F.col("_n")
    pieces = pieces.select(*whole, "next_id", "_low", "_end", "_n", missing.alias("_missing"), F.when(missing > 0, F.col("_last") - run).alias("_gap"))
    pieces = pieces.withColumn("_stop", F.min("_end").over(Window.partitionBy("segment_id"))).filter(F.col("_stop").isNull() | (F.col("_low") <= F.col("_stop.id")))

    rows = pieces.groupBy(*whole, "next_id").agg(F.first("_stop").alias("_stop"), F.sum("_n").alias("n_found"), F.sum("_missing").alias("n_missing"), F.max("_gap").alias("_gap"))
    begun = F.coalesce(F.col("_gap"), F.col("next_id") - 1)
    flushed = begun + F.floor((F.coalesce(F.col("_stop.id") - 1, F.col("end_id")) - begun) / size) * size
    rows = rows.withColumn("_durable", F.when(flushed > begun, flushed).otherwise(F.col("_gap"))).withColumn("failed_id", F.col("_stop.id")).withColumn("_result", F.col("_stop.result"))
    rows = rows.unionByName(started.filter("NOT coalesce(next_id <= end_id, FALSE)"), allowMissingColumns=True)
    valid = (F.col("start_id") > 0) & (F.col("start_id") <= F.col("end_id")) & (F.col("scan_cursor_id").isNull() | F.col("scan_cursor_id").between(F.col("start_id") - 1, F.col("end_id")))
    outcome = F.when(~valid, "fatal").otherwise(F.coalesce("_result", F.lit("completed")))
    resumed = F.when(F.col("scan_cursor_id") >= F.col("start_id"), F.col("scan_cursor_id"))
    last = F.when(~valid, None).when(outcome == "completed", F.col("end_id")).otherwise(F.coalesce("_durable", resumed))
    left = F.when(outcome == "completed", F.lit(0)).otherwise(F.greatest(F.col("end_id") - F.coalesce(last + 1, F.col("start_id")) + 1, F.lit(0)))
    zero = F.lit(0).cast("long")
    return rows.select("segment_id", outcome.alias("outcome"), last.alias("last_durable_id"), left.cast("long").alias("unresolved"), "failed_id", F.coalesce("n_found", zero).alias("n_found"), F.coalesce("n_missing", zero).alias("n_missing"))


def failure_payload(run_id: Column, segment_id: Column, item_id: Column, attempts: Column, failure_class: Column, message: Column) -> Column:
    fields = F.struct(attempts.alias("attempts"), F.lit(None).cast("string").alias("diagnostics"), F.coalesce(failure_class, F.lit("unknown")).alias("failure_class"), item_id.alias("item_id"), message.alias("message"), run_id.alias("run_id"), segment_id.alias("segment_id"))
    return F.to_json(fields, {"ignoreNullFields": "false"})
