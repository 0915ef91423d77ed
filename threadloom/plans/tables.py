"""Queries on sources, sinks, upserts and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import export, metrics, upsert
from threadloom.plans.fixtures import frame, oracle
from threadloom.plans.registry import query
from threadloom.sources import items as item_source
from threadloom.sources.scratch import Scratch


def _truth(path: str, depth: int = 4) -> str:
    """DuckDB's reading of a tolerant boolean in the payload."""
    word = f"lower(trim(payload ->> '{path}'))"
    inner = f"WHEN 'ARRAY' THEN {_truth(path + '[0]', depth - 1)}" if depth else ""
    return f"""(CASE json_type(payload, '{path}') WHEN 'BOOLEAN' THEN payload ->> '{path}' = 'true' WHEN 'UBIGINT' THEN CAST(payload ->> '{path}' AS DOUBLE) <> 0 WHEN 'BIGINT' THEN CAST(payload ->> '{path}' AS DOUBLE) <> 0
      WHEN 'DOUBLE' THEN CAST(payload ->> '{path}' AS DOUBLE) <> 0 WHEN 'VARCHAR' THEN CASE WHEN {word} IN ('true', '1', 'yes') THEN TRUE WHEN {word} IN ('false', '0', 'no') THEN FALSE END {inner} END)"""


TRUTH = _truth("$.deleted")
#: Whether an item's score is a number or absent, without which it is rejected.
SOUND = "coalesce(json_type(payload, '$.score'), 'NULL') IN ('UBIGINT', 'BIGINT', 'NULL')"
LAST = "row_number() OVER (PARTITION BY item, kid ORDER BY shipped DESC, display_order DESC, price DESC) = 1"
ORDER = ["shipped", "display_order", "price"]


@query(oracle("SELECT event_id, " + TRUTH + " AS deleted FROM fx_json", "fx_json"))
def tolerant_bool(spark, sf_dir):
    return frame(spark, sf_dir, "fx_json").select("event_id", item_source.tolerant_bool(F.col("payload"), "deleted").alias("deleted"))


@query(oracle(f"""SELECT event_id, CASE WHEN {SOUND} THEN CAST(payload ->> '$.id' AS BIGINT) END AS id, CASE WHEN {SOUND} THEN {TRUTH} END AS deleted,
  CASE WHEN {SOUND} THEN CAST(payload ->> '$.score' AS BIGINT) END AS score, CASE WHEN NOT {SOUND} THEN 'decode' END AS failure_class FROM fx_json""", "fx_json"))
def decode_items(spark, sf_dir):
    return item_source.decode_items(frame(spark, sf_dir, "fx_json")).select("event_id", "item.id", "item.deleted", "item.score", "failure_class")


@query(oracle(f"""WITH k AS (SELECT CAST(payload ->> '$.id' AS BIGINT) AS item, CAST(json_extract(payload, '$.kids') AS BIGINT[]) AS kids FROM fx_json WHERE {SOUND})
SELECT item, unnest(kids) AS kid, CAST(generate_subscripts(kids, 1) - 1 AS BIGINT) AS display_order FROM k""", "fx_json"))
def explode_kids(spark, sf_dir):
    return item_source.kid_rows(item_source.decode_items(frame(spark, sf_dir, "fx_json"), only=("id", "kids")))


@query("SELECT max(event_id) AS max_id FROM events")
def src_max_id(spark, sf_dir):
    return frame(spark, sf_dir, "events").agg(F.max("event_id").alias("max_id"))


SCRIPT = "CASE event_id % 4 WHEN 0 THEN [429, 429, 200] WHEN 1 THEN [503] WHEN 2 THEN [401, 200] ELSE [] END"


@query("SELECT event_id, attempt, CAST(coalesce((" + SCRIPT + ")[attempt], 200) AS INT) AS status FROM events, (SELECT unnest([1, 2, 3, 4]) AS attempt)")
def src_scripted_status(spark, sf_dir):
    event = F.col("event_id") % 4
    script = F.when(event == 0, F.array(F.lit(429), F.lit(429), F.lit(200))).when(event == 1, F.array(F.lit(503))).when(event == 2, F.array(F.lit(401), F.lit(200))).otherwise(F.array().cast("array<int>"))
    rows = frame(spark, sf_dir, "events").select("event_id", script.alias("script"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("attempt"))
    return rows.select("event_id", "attempt", item_source.scripted_status(F.col("script"), F.col("attempt")).alias("status"))


def _old_new(spark, sf_dir):
    lines = frame(spark, sf_dir, "fx_lines")
    keys = ["item", "kid"]
    return upsert.last_per_key(lines.filter("display_order <= 4"), keys, ORDER), upsert.last_per_key(lines.filter("display_order >= 4"), keys, ORDER)


BATCHES = f"""WITH old AS (SELECT * FROM fx_lines WHERE display_order <= 4 QUALIFY {LAST}), new AS (SELECT * FROM fx_lines WHERE display_order >= 4 QUALIFY {LAST})
"""


@query(oracle(BATCHES + "SELECT item, kid, coalesce(n.display_order, o.display_order) AS display_order FROM old o FULL JOIN new n USING (item, kid)", "fx_lines"))
def upsert_kids(spark, sf_dir):
    old, new = (x.select("item", "kid", "display_order") for x in _old_new(spark, sf_dir))
    return upsert.upsert(old, new, ["item", "kid"])


ITEM_BATCHES = """WITH old AS (SELECT id, type, score, CASE WHEN id % 3 <> 1 THEN story_id END AS story_id FROM fx_items WHERE id % 5 < 4),
new AS (SELECT id, type, CASE WHEN id % 7 <> 2 THEN score + 1 END AS score, CASE WHEN id % 2 = 0 THEN story_id + 5 END AS story_id FROM fx_items WHERE id % 5 > 2)
"""


def _item_batches(spark, sf_dir):
    items = frame(spark, sf_dir, "fx_items")
    old = items.filter("id % 5 < 4").select("id", "type", "score", F.when(F.col("id") % 3 != 1, F.col("story_id")).alias("story_id"))
    new = items.filter("id % 5 > 2").select("id", "type", F.when(F.col("id") % 7 != 2, F.col("score") + 1).alias("score"), F.when(F.col("id") % 2 == 0, F.col("story_id") + 5).alias("story_id"))
    return old, new


@query(oracle(ITEM_BATCHES + "SELECT id, coalesce(n.type, o.type) AS type, CASE WHEN n.id IS NOT NULL THEN n.score ELSE o.score END AS score, coalesce(n.story_id, o.story_id) AS story_id FROM old o FULL JOIN new n USING (id)", "fx_items"))
def upsert_items(spark, sf_dir):
    return upsert.upsert_items(*_item_batches(spark, sf_dir))


@query(oracle(ITEM_BATCHES + "SELECT id, coalesce(n.type, o.type) AS type, CASE WHEN n.id IS NOT NULL THEN n.score ELSE o.score END AS score, o.story_id FROM old o FULL JOIN new n USING (id)", "fx_items"))
def upsert_items_legacy(spark, sf_dir):
    return upsert.upsert_items_legacy(*_item_batches(spark, sf_dir))


@query(oracle("""WITH n AS (SELECT segment_id, item_id, 'retry_wait' AS state, attempts + 1 AS attempts, 'late' AS last_error, 'network_transient' AS failure_class FROM fx_exceptions WHERE segment_id % 2 = 0
  UNION ALL SELECT segment_id, item_id + 1, 'terminal_missing', 1, NULL, NULL FROM fx_exceptions WHERE segment_id % 5 = 0)
SELECT segment_id, item_id, coalesce(n.state, o.state) AS state, coalesce(n.attempts, o.attempts) AS attempts, CASE WHEN n.state IS NOT NULL THEN n.last_error ELSE o.last_error END AS last_error,
  CASE WHEN n.state IS NOT NULL THEN n.failure_class ELSE o.failure_class END AS failure_class FROM fx_exceptions o FULL JOIN n USING (segment_id, item_id)""", "fx_exceptions"))
def upsert_exceptions(spark, sf_dir):
    old = frame(spark, sf_dir, "fx_exceptions")
    again = old.filter("segment_id % 2 = 0").select("segment_id", "item_id", F.lit("retry_wait").alias("state"), (F.col("attempts") + 1).alias("attempts"), F.lit("late").alias("last_error"), F.lit("network_transient").alias("failure_class"))
    gone = old.filter("segment_id % 5 = 0").select("segment_id", (F.col("item_id") + 1).alias("item_id"), F.lit("terminal_missing").alias("state"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("failure_class"))
    return upsert.upsert(old, again.unionByName(gone), ["segment_id", "item_id"])


@query(oracle("SELECT item, kid, display_order, price FROM fx_lines QUALIFY row_number() OVER (PARTITION BY item ORDER BY shipped DESC, display_order DESC, price DESC) = 1", "fx_lines"))
def dedupe_items(spark, sf_dir):
    # Whole rows by item; kid joins the order's tail only where all else ties.
    return upsert.last_per_key(frame(spark, sf_dir, "fx_lines"), ["item"], ORDER).select("item", "kid", "display_order", "price")


@query(oracle(f"SELECT item, kid, display_order, price FROM fx_lines QUALIFY {LAST}", "fx_lines"))
def dedupe_kids(spark, sf_dir):
    return upsert.last_per_key(frame(spark, sf_dir, "fx_lines"), ["item", "kid"], ORDER).select("item", "kid", "display_order", "price")


@query(oracle("SELECT count(*) - count(DISTINCT (item, kid)) AS n_duplicates FROM fx_lines", "fx_lines"))
def duplicate_count(spark, sf_dir):
    return upsert.duplicates(frame(spark, sf_dir, "fx_lines"), ["item", "kid"])


def _exported(spark, sf_dir, name, order):
    """The export's rows, from shards of 200 kB."""
    scratch = Scratch(spark)
    table = frame(spark, sf_dir, name)
    export.export(table, scratch.path(name), order, shard_bytes=200_000)
    return spark.read.parquet(scratch.path(name)).select(*table.columns)


@query(oracle("SELECT * FROM fx_items", "fx_items"))
def export_items(spark, sf_dir):
    return _exported(spark, sf_dir, "fx_items", ["id"])


@query(oracle("SELECT * FROM fx_kids", "fx_kids"))
def export_kids(spark, sf_dir):
    return _exported(spark, sf_dir, "fx_kids", ["item", "kid"])


#: Rates of samples s(series, t, value) at each minute, from all pairs of samples and ranges.
RATES = """, grid AS (SELECT series, unnest(range((min(t) // 60) * 60, max(t) + 361, 60)) AS "at" FROM s GROUP BY series),
inside AS (SELECT g.series, g."at", s.t, s.value, lag(s.value) OVER (PARTITION BY g.series, g."at" ORDER BY s.t) AS prev FROM grid g JOIN s ON s.series = g.series AND s.t > g."at" - 300 AND s.t <= g."at"),
seen AS (SELECT series, "at", count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(value, t) AS v0, arg_max(value, t) - arg_min(value, t) + sum(CASE WHEN prev > value THEN prev ELSE 0 END) AS inc FROM inside GROUP BY ALL HAVING count(*) >= 2),
gaps AS (SELECT *, CAST(t1 - t0 AS DOUBLE) AS d, CAST(t1 - t0 AS DOUBLE) / (n - 1) AS gap, CAST(t0 - "at" + 300 AS DOUBLE) AS s0, CAST("at" - t1 AS DOUBLE) AS e0 FROM seen),
edged AS (SELECT *, CASE WHEN s0 >= gap * 1.1 THEN gap / 2 ELSE s0 END AS s1, CASE WHEN e0 >= gap * 1.1 THEN gap / 2 ELSE e0 END AS e1 FROM gaps),
r AS (SELECT series, "at" AS t, inc * (d + CASE WHEN inc > 0 AND v0 >= 0 THEN least(s1, d * v0 / inc) ELSE s1 END + e1) / d / 300 AS rate FROM edged WHERE d > 0)
"""
SAMPLES = """WITH s AS (SELECT event_type AS series, event_id * 20 + (event_id * 7) % 15 AS t, CAST(sum(floor(value) % 10) OVER (PARTITION BY event_type, event_id // 500 ORDER BY event_id) AS DOUBLE) AS value
  FROM events WHERE event_id % 400 < 300 AND (event_type <> 'click' OR event_id % 7 = 0))"""


@query(SAMPLES + RATES + "SELECT series, t, round(rate, 9) AS rate FROM r")
def rate_5m(spark, sf_dir):
    samples = spark.sql(SAMPLES.removeprefix("WITH s AS (").removesuffix(")").replace("//", "div").replace("FROM events", "FROM {events}"), events=frame(spark, sf_dir, "events"))
    return metrics.rate(samples).withColumn("rate", F.round("rate", 9))


@query(oracle("""WITH n AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE score END AS score, CASE WHEN id % 10 = 1 THEN NULL ELSE dead END AS dead, text FROM fx_all)
SELECT n.* FROM n LEFT JOIN fx_items o USING (id) WHERE o.id IS NULL OR n.score IS DISTINCT FROM o.score OR n.dead IS DISTINCT FROM o.dead OR n.text IS DISTINCT FROM o.text""", "fx_items"))
def changed_items(spark, sf_dir):
    batch = frame(spark, sf_dir, "fx_all").selectExpr("id", "CASE WHEN id % 6 <> 0 THEN score END AS score", "CASE WHEN id % 10 <> 1 THEN dead END AS dead", "text")
    return upsert.changed(frame(spark, sf_dir, "fx_items"), batch, ["id"])


@query(oracle("SELECT item, kid, display_order FROM fx_kids WHERE kid % 100 <> 42 UNION ALL SELECT 5000000, 5000001, NULL", "fx_kids"))
def insert_delete(spark, sf_dir):
    kids = frame(spark, sf_dir, "fx_kids")
    row = spark.range(1).selectExpr("5000000L AS item", "5000001L AS kid")
    return upsert.insert(upsert.delete(kids, kids.filter("kid % 100 = 42").select("item", "kid")), row)
