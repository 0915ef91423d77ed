"""Views of threaded items, segments and responses over the test tables: the same SQL for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_all": """
      SELECT event_id AS id, event_id - event_id % 50 AS story_id, CASE WHEN event_id % 50 = 0 THEN 'story' ELSE 'comment' END AS type,
        CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id - event_id % 50 + greatest(0, event_id % 50 - 1 - (event_id * 7) % 5) END AS parent,
        CAST(floor(value) AS BIGINT) AS score, 1160000000 + event_id * 4000 AS time,
        event_id % 23 = 7 AND event_id % 50 <> 0 AS deleted, CASE WHEN event_id % 31 = 9 AND event_id % 50 <> 0 THEN TRUE END AS dead,
        CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('<p>', event_type, ' & "', CAST(event_id AS STRING), '"') END AS text,
        CASE WHEN event_id % 150 = 0 THEN NULL ELSE concat('user', CAST(user_id AS STRING)) END AS author FROM {events}""",
    "fx_items": "SELECT * FROM {fx_all} WHERE NOT (id % 97 = 5 AND id % 50 <> 0)",
    "fx_kids": """
      SELECT parent AS item, id AS kid, CAST(row_number() OVER (PARTITION BY parent ORDER BY score DESC, id) - 1 AS BIGINT) AS display_order
      FROM {fx_all} WHERE parent IS NOT NULL AND id % 11 <> 4
      UNION ALL SELECT id, id + 1000000, CAST(0 AS BIGINT) FROM {fx_all} WHERE id % 101 = 1""",
    "fx_cross": """
      SELECT item, kid, display_order FROM {fx_kids} UNION ALL SELECT id, id + 53, CAST(7 AS BIGINT) FROM {fx_all} WHERE id % 29 = 3""",
    "fx_bare": "SELECT id, type, parent, CASE WHEN id % 400 < 50 AND type = 'story' THEN id END AS story_id FROM {fx_items}",
    "fx_segments": """
      SELECT o_orderkey + 1 AS segment_id, o_orderkey * 20 + 1 AS start_id, o_orderkey * 20 + 20 - CASE WHEN o_orderkey % 37 = 30 THEN 3 ELSE 0 END AS end_id,
        CASE WHEN o_orderkey % 11 < 7 OR o_orderkey < 40 THEN 'done' WHEN o_orderkey % 11 = 7 THEN 'pending' WHEN o_orderkey % 11 = 8 THEN 'in_progress'
          WHEN o_orderkey % 11 = 9 THEN 'retry_wait' ELSE 'dead_letter' END AS status,
        CAST(o_orderkey % 4 AS INT) AS attempts, CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey * 20 + 7 END AS scan_cursor_id,
        CAST(o_orderkey % 21 AS INT) AS unresolved_count, CASE WHEN o_orderkey % 11 > 8 THEN 'boom' END AS last_error,
        CASE WHEN o_orderkey % 11 = 9 THEN 'network_transient' WHEN o_orderkey % 11 = 10 THEN 'http_4xx' END AS failure_class FROM {orders}""",
    "fx_exceptions": """
      SELECT o_orderkey + 1 AS segment_id, o_orderkey * 20 + 3 AS item_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry_wait' WHEN 2 THEN 'terminal_missing' ELSE 'dead_letter' END AS state,
        CAST(o_orderkey % 5 AS INT) AS attempts, 'missing upstream' AS last_error, CASE WHEN o_orderkey % 4 = 3 THEN 'http_4xx' END AS failure_class
      FROM {orders} WHERE o_orderkey % 3 = 0""",
    "fx_http": """
      SELECT event_id AS item_id, CAST(CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 418 WHEN 5 THEN 429
        WHEN 6 THEN 500 WHEN 7 THEN 503 ELSE 302 END AS INT) AS status FROM {events}""",
    "fx_json": """
      SELECT event_id, concat('{{"id":', CAST(event_id AS STRING), ',"type":"comment","deleted":',
        CASE event_id % 12 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN '" YES "' WHEN 5 THEN '"no"' WHEN 6 THEN '"maybe"'
          WHEN 7 THEN '[true]' WHEN 8 THEN '[]' WHEN 9 THEN '{{}}' WHEN 10 THEN '[["0"]]' ELSE 'null' END,
        ',"score":', CASE WHEN event_id % 17 = 3 THEN '"high"' ELSE CAST(event_id % 100 AS STRING) END,
        ',"kids":[', CAST(event_id + 1 AS STRING), ',', CAST(event_id + 2 AS STRING), ']}}') AS payload FROM {events}""",
    "fx_log": """
      SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'backfill-kids.service' WHEN 1 THEN 'backfill-.service' WHEN 2 THEN 'x-catchup-worker-1.service'
          ELSE concat('catchup-worker-', CAST(event_id % 3 AS STRING), '.service') END AS unit,
        CASE WHEN event_id % 13 = 5 THEN 'panic: not json' ELSE concat('{{"timestamp":"2026-02-13T', lpad(CAST(CAST(floor((event_id % 1440) / 60) AS BIGINT) AS STRING), 2, '0'), ':',
          lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':30.250000Z","level":"INFO","event":"', CASE event_id % 7 WHEN 0 THEN 'segment_claimed' WHEN 1 THEN 'segment_completed'
            WHEN 2 THEN 'segment_retry_wait' WHEN 3 THEN 'segment_dead_letter' ELSE 'progress' END, '","segment_id":', CAST(event_id % 50 AS STRING),
          CASE WHEN event_id % 7 > 3 THEN concat(',"pending_segments":', CAST(event_id % 40 AS STRING), ',"progress_percent":', CAST(event_id % 101 AS STRING)) ELSE '' END,
          CASE WHEN event_id % 2 = 0 THEN ',"run_id":"run-' ELSE ',"span":{{"run_id":"run-' END, CAST(event_id % 3 AS STRING), CASE WHEN event_id % 2 = 0 THEN '"}}' ELSE '"}}}}' END) END AS line FROM {events}""",
    "fx_lines": """
      SELECT l_orderkey AS item, l_partkey AS kid, CAST(l_linenumber AS BIGINT) AS display_order, l_shipdate AS shipped, l_extendedprice AS price FROM {lineitem}""",
}


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if "{" + v + "}" in text]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the test data."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {x: frame(spark, sf_dir, x) for x in (*_needs(text), "events", "orders", "lineitem") if "{" + x + "}" in text}
    return spark.sql(text, **used)


def oracle(query: str, *views: str) -> str:
    """A DuckDB query with the views it needs in front; ``WITH`` of the query itself is merged."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _needs(VIEWS[name]):
            add(x)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    names = {x: x for x in (*VIEWS, "events", "orders", "lineitem")}
    parts = ", ".join(f"{v} AS ({VIEWS[v].format(**names)})" for v in order)
    body = query.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    inner = body[len("WITH RECURSIVE") :] if recursive else body[len("WITH") :] if body.upper().startswith("WITH") else ""
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + parts + (", " + inner.strip() if inner else " " + body)
