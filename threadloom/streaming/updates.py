"""The change stream: decode update events, follow the changed ids, fetch them, apply the latest state of each."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.upsert import last_per_key
from threadloom.sources.schemas import UPDATES
from threadloom.sources.scratch import Scratch
from threadloom.streaming.counters import Counters
from threadloom.streaming.snapshot import Snapshot


def changed_ids(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``item_id`` for each id of an update event; keep-alives and unparseable events give no row. Batch or stream."""
    update = F.from_json(F.col(payload), UPDATES, {"mode": "PERMISSIVE"})
    return events.withColumn("_ids", update["data"]["items"]).withColumn("item_id", F.explode("_ids")).drop("_ids")


def drain(query: StreamingQuery, stop: threading.Event | None = None, every: float = 0.2) -> None:
    """Lets a started query take all that is there now, then stops it; earlier, between two batches, if ``stop`` is set. What it has done stays done, and a later start goes on from there."""
    done = threading.Event()

    def finish() -> None:
        with contextlib.suppress(Exception):  # told below, by the query itself
            query.processAllAvailable()
        done.set()

    worker = threading.Thread(target=finish, daemon=True)
    worker.start()
    while not done.wait(every):
        if stop is not None and stop.is_set():
            break
    failed = query.exception()
    query.stop()
    worker.join()
    if failed is not None:
        raise failed


def run_to_table(stream: DataFrame, scratch: Scratch, name: str, stop: threading.Event | None = None) -> DataFrame:
    """Runs a stream over what is there now, and the written rows."""
    query = stream.writeStream.format("parquet").option("path", scratch.path(name)).option("checkpointLocation", scratch.path(f"{name}-progress")).start()
    drain(query, stop)
    return scratch.spark.read.schema(stream.schema).parquet(scratch.path(name))


def latest_by_key(stream: DataFrame, scratch: Scratch, name: str, keys: list[str], order: list[str], buckets: int = 64, stop: threading.Event | None = None) -> DataFrame:
    """Applies a stream of changes to a snapshot in buckets, micro-batch by micro-batch, and the snapshot. A run after a restart goes on where the last one ended."""
    table = Snapshot(scratch, name, stream.schema, keys, buckets)
    drain(table.follow(stream, order).start(), stop)
    return table.read()


def follow_items(ids: DataFrame, fetch, table: Snapshot, counters: Counters | None = None, strict: bool = True, stop: threading.Event | None = None) -> None:
    """Fetches the items that a stream of ``item_id`` names, each once a batch, and applies those found to the table.

    ``fetch(ids)``: rows of the table's schema with ``status`` found, missing or error, for a table of distinct ids. An error fails the batch, which a restart replays; if not
    ``strict`` it is counted and passed over.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        named = table.scratch.table(f"{table.name}-named", rows.groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("times")))
        fetched, times = fetch(named.select("id")), Observation()
        joined = fetched.join(named, "id").observe(times, F.sum(F.when(F.col("status") != "error", F.col("times"))).alias("pulled"), F.sum(F.when(F.col("status") == "error", F.col("times"))).alias("failed"))
        fetched = table.scratch.table(f"{table.name}-fetched", joined)
        seen = times.get
        if seen["failed"] and strict:
            raise RuntimeError(f"{seen['failed']} items could not be fetched")
        table.apply(last_per_key(fetched.filter("status = 'found'").select(*table.schema.names), table.keys, table.keys), batch)
        if counters is not None:
            counters.add(batch, seen["pulled"] or 0, seen["failed"] or 0)

    stream = ids.observe(Counters.NAME, F.count(F.lit(1)).alias("size"))
    if counters is not None:
        ids.sparkSession.streams.addListener(counters)
    try:
        drain(stream.writeStream.foreachBatch(apply).option("checkpointLocation", table.scratch.path(f"{table.name}-progress")).start(), stop)
    finally:
        if counters is not None:
            counters.ended.wait(30)
            ids.sparkSession.streams.removeListener(counters)
