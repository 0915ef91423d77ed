"""Queries on the change stream and on items fetched by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans.fixtures import frame
from threadloom.plans.registry import query
from threadloom.sources import events, item_source
from threadloom.sources import items as decoding
from threadloom.sources.schemas import PAYLOAD
from threadloom.sources.scratch import Scratch
from threadloom.streaming import updates
from threadloom.streaming.counters import Counters
from threadloom.streaming.snapshot import Snapshot

#: Ids without a stored payload, ids whose payload is cut off, and ids whose payload is null.
STORED = "event_id % 9 <> 4"
PAYLOADS = "CASE event_id % 25 WHEN 3 THEN substr(payload, 1, 20) WHEN 8 THEN 'null' ELSE payload END"
WIDTH = 20_000
#: A quarter of the events is at least four tasks, and more where that would make a task longer than this.
TASK_BYTES = 1 << 24


def _stored(spark, sf_dir, scratch):
    """Shards of the test payloads, and the options that read them."""
    path = scratch.path("payloads")
    item_source.store(frame(spark, sf_dir, "fx_json").filter(STORED).selectExpr("event_id AS id", PAYLOADS + " AS payload"), path, WIDTH)
    return {"path": path, "width": WIDTH}


STATUS = f"CASE WHEN e.event_id IS NULL OR NOT e.{STORED} OR r.id % 25 = 8 THEN 'missing' WHEN r.id % 25 = 3 THEN 'error' ELSE 'found' END"


@query(f"""SELECT r.id, {STATUS} AS status, CASE WHEN {STATUS} = 'found' AND r.id % 17 <> 3 THEN r.id % 100 END AS score, {STATUS} = 'error' AS failed
FROM (SELECT unnest(range((SELECT min(event_id) FROM events), (SELECT max(event_id) FROM events) + 4)) AS id) r LEFT JOIN events e ON e.event_id = r.id""")
def src_items_json(spark, sf_dir):
    first, last = frame(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    rows = item_source.items_between(spark, first, last + 3, ids_per_task=WIDTH, **_stored(spark, sf_dir, Scratch(spark)))
    return decoding.decode_items(rows).select("id", "status", "item.score", F.col("error").isNotNull().alias("failed"))


UPDATE = """CASE event_id % 10 WHEN 3 THEN 'null' WHEN 7 THEN 'not json'
  ELSE concat('{"path":"/","data":{"items":[', CAST(event_id AS STRING), ',', CAST(event_id + 7 AS STRING), '],"profiles":["x"]}}') END"""


def _updates(spark, sf_dir, scratch):
    """The stream of update events, recorded in two files and read in batches of a quarter of them or so."""
    rows = frame(spark, sf_dir, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 10 = 3 THEN 'keep-alive' ELSE 'put' END AS event", UPDATE + " AS data")
    path = scratch.path("recorded")
    events.record(rows.repartition(2, "id"), path)
    size = events.recorded_bytes(path)
    return updates.changed_ids(events.events(spark, path, max_bytes=size // 4 + 1, task_bytes=min(size // 16 + 1, TASK_BYTES)), "data")


@query("SELECT event_id, event_id + o AS item_id FROM events, (SELECT unnest([0, 7]) AS o) WHERE event_id % 10 NOT IN (3, 7)")
def stream_updates_explode(spark, sf_dir):
    scratch = Scratch(spark)
    return updates.run_to_table(_updates(spark, sf_dir, scratch).select(F.col("id").cast("long").alias("event_id"), "item_id"), scratch, "ids")


@query("SELECT user_id AS id, event_id AS seq, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert_latest(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, since a stream's plain path must be a folder
    changes = rows.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return updates.latest_by_key(changes, Scratch(spark), "items", ["id"], ["seq"], buckets=8)


def _followed(spark, sf_dir, counters=None):
    """The items that the update stream names, fetched and kept."""
    scratch = Scratch(spark)
    options = _stored(spark, sf_dir, scratch)
    kept = [f for f in PAYLOAD.fields if f.name in ("id", "type", "score")]

    def fetch(ids):
        rows = decoding.decode_items(item_source.items_of(ids, **options))
        return rows.withColumn("status", F.when(F.col("failure_class").isNotNull(), "error").otherwise(F.col("status"))).select("id", "status", "item.type", "item.score")

    table = Snapshot(scratch, "items", type(PAYLOAD)(kept), ["id"], buckets=8)
    updates.follow_items(_updates(spark, sf_dir, scratch).select("item_id"), fetch, table, counters, strict=False)
    return table.read()


NAMED = f"""WITH named AS (SELECT event_id + o AS id FROM events, (SELECT unnest([0, 7]) AS o) WHERE event_id % 10 NOT IN (3, 7)),
known AS (SELECT r.id, CASE WHEN {STATUS} = 'found' AND r.id % 17 = 3 THEN 'error' ELSE {STATUS} END AS status FROM named r LEFT JOIN events e ON e.event_id = r.id)
"""


@query(NAMED + "SELECT DISTINCT id, 'comment' AS type, id % 100 AS score FROM known WHERE status = 'found'")
def stream_items(spark, sf_dir):
    return _followed(spark, sf_dir)


@query(NAMED + "SELECT count(*) AS named, count(*) FILTER (status <> 'error') AS records_pulled, count(*) FILTER (status = 'error') AS records_failed FROM known")
def stream_counters(spark, sf_dir):
    counters = Counters()
    _followed(spark, sf_dir, counters)
    totals = counters.totals()
    return spark.createDataFrame([[totals[c] for c in ("named", "records_pulled", "records_failed")]], "named long, records_pulled long, records_failed long")
