"""Queries on segments, coverage and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import classify, sizing
from threadloom.operators import attempts, intervals, metrics, segments, upsert
from threadloom.plans.fixtures import frame, oracle
from threadloom.plans.registry import query

COLUMNS = "segment_id, start_id, end_id, status, attempts, scan_cursor_id, unresolved_count, last_error, failure_class"


def _segments(spark, sf_dir):
    return frame(spark, sf_dir, "fx_segments")


@query(oracle(f"SELECT {COLUMNS} FROM fx_segments WHERE status = 'dead_letter' ORDER BY start_id, segment_id LIMIT 50", "fx_segments"))
def seg_by_status(spark, sf_dir):
    return segments.by_status(_segments(spark, sf_dir), "dead_letter", 50)


@query(oracle("SELECT segment_id, start_id, end_id FROM fx_segments WHERE status = 'pending' AND end_id >= 5000 AND start_id <= 250000", "fx_segments"))
def seg_pending_window(spark, sf_dir):
    return segments.pending_in_window(_segments(spark, sf_dir), 5000, 250000).select("segment_id", "start_id", "end_id")


@query(oracle("SELECT segment_id, item_id, attempts FROM fx_exceptions WHERE state = 'terminal_missing' ORDER BY segment_id, item_id LIMIT 100", "fx_exceptions"))
def exc_by_state(spark, sf_dir):
    return frame(spark, sf_dir, "fx_exceptions").filter("state = 'terminal_missing'").select("segment_id", "item_id", "attempts").orderBy("segment_id", "item_id").limit(100)


@query(oracle("SELECT segment_id, start_id, end_id FROM fx_segments WHERE end_id >= 777 AND start_id <= 12345", "fx_segments"))
def interval_overlap(spark, sf_dir):
    return intervals.overlapping(_segments(spark, sf_dir), 777, 12345).select("segment_id", "start_id", "end_id")


@query(oracle("SELECT segment_id, item_id, state FROM fx_exceptions WHERE segment_id IN (SELECT segment_id FROM fx_segments WHERE end_id >= 777 AND start_id <= 12345)", "fx_segments", "fx_exceptions"))
def in_subquery(spark, sf_dir):
    hit = intervals.overlapping(_segments(spark, sf_dir), 777, 12345).select("segment_id")
    return frame(spark, sf_dir, "fx_exceptions").join(hit, "segment_id", "left_semi").select("segment_id", "item_id", "state")


@query(oracle("SELECT e.segment_id, e.item_id, e.state, s.status FROM fx_exceptions e JOIN fx_segments s USING (segment_id)", "fx_segments", "fx_exceptions"))
def exceptions_with_segments(spark, sf_dir):
    return frame(spark, sf_dir, "fx_exceptions").select("segment_id", "item_id", "state").join(_segments(spark, sf_dir).select("segment_id", "status"), "segment_id")


@query(oracle("SELECT segment_id, item_id, state FROM fx_exceptions WHERE segment_id NOT IN (SELECT segment_id FROM fx_segments WHERE status = 'done')", "fx_segments", "fx_exceptions"))
def cascade_delete(spark, sf_dir):
    removed = _segments(spark, sf_dir).filter("status = 'done'")
    return upsert.cascade_delete(frame(spark, sf_dir, "fx_exceptions").select("segment_id", "item_id", "state"), removed, "segment_id")


@query(oracle("""WITH b AS (SELECT segment_id, CASE WHEN segment_id % 6 = 1 THEN end_id + 1 ELSE start_id END AS start_id, end_id, CASE WHEN segment_id % 10 = 3 THEN 'lost' ELSE status END AS status, attempts - 1 AS attempts, failure_class FROM fx_segments),
v AS (SELECT segment_id, concat_ws(',', CASE WHEN NOT start_id <= end_id THEN 'start_before_end' END, CASE WHEN NOT attempts >= 0 THEN 'attempts_not_negative' END,
  CASE WHEN status NOT IN ('pending', 'in_progress', 'done', 'retry_wait', 'dead_letter') THEN 'status_known' END) AS violated FROM b)
SELECT * FROM v WHERE violated <> ''""", "fx_segments"))
def constraint_violations(spark, sf_dir):
    odd = F.col("segment_id")
    broken = _segments(spark, sf_dir).withColumns({"start_id": F.when(odd % 6 == 1, F.col("end_id") + 1).otherwise(F.col("start_id")), "status": F.when(odd % 10 == 3, "lost").otherwise(F.col("status")), "attempts": F.col("attempts") - 1})
    return upsert.violations(broken, segments.checks()).select("segment_id", F.array_join("violated", ",").alias("violated"))


@query(oracle("""WITH r AS (SELECT 1000000 + o_orderkey * 40 AS start_id, 1000000 + o_orderkey * 40 + 29 AS end_id FROM orders WHERE o_orderkey % 10 = 0)
SELECT segment_id, start_id, end_id, status, attempts, unresolved_count FROM fx_segments UNION ALL
SELECT (SELECT max(segment_id) FROM fx_segments) + row_number() OVER (ORDER BY start_id, end_id), start_id, end_id, 'pending', 0, 30 FROM r""", "fx_segments"))
def seg_enqueue(spark, sf_dir):
    new = frame(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").selectExpr("1000000 + o_orderkey * 40 AS start_id", "1000000 + o_orderkey * 40 + 29 AS end_id")
    return segments.enqueue(_segments(spark, sf_dir), new).select("segment_id", "start_id", "end_id", "status", "attempts", "unresolved_count")


@query("SELECT s AS start_id, least(s + 999, (SELECT max(o_orderkey) FROM orders)) AS end_id FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) FROM orders) + 1, 1000)) AS s)")
def enqueue_range(spark, sf_dir):
    top = frame(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return intervals.enqueue_range(1, top, 1000, spark)


SWEEP = """WITH swept AS (SELECT start_id, end_id, max(end_id) OVER (ORDER BY start_id, end_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM fx_segments WHERE {where})
"""


@query(oracle(SWEEP.format(where="status = 'done'") + "SELECT coalesce((SELECT max(end_id) FROM swept WHERE start_id < coalesce((SELECT min(start_id) FROM swept WHERE start_id > coalesce(reached, 0) + 1), 9223372036854775807)), 0) AS frontier", "fx_segments"))
def frontier(spark, sf_dir):
    return intervals.frontier(_segments(spark, sf_dir).filter("status = 'done'"))


def _target(spark, sf_dir):
    """Some ids beyond the last segment."""
    return _segments(spark, sf_dir).agg(F.max("end_id")).first()[0] + 5000


@query(oracle(SWEEP.format(where="end_id >= 501") + """, top AS (SELECT max(end_id) + 5000 AS target FROM fx_segments)
SELECT greatest(coalesce(reached, 500), 500) + 1 AS start_id, start_id - 1 AS end_id FROM swept WHERE greatest(coalesce(reached, 500), 500) + 1 <= start_id - 1
UNION ALL SELECT m + 1, target FROM (SELECT greatest(coalesce(max(end_id), 500), 500) AS m FROM swept), top WHERE m + 1 <= target""", "fx_segments"))
def uncovered_ranges(spark, sf_dir):
    return intervals.uncovered(_segments(spark, sf_dir), 501, _target(spark, sf_dir))


@query("WITH i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 3), l AS (SELECT id, coalesce(lag(id) OVER (ORDER BY id), 0) + 1 AS s FROM i) SELECT s AS start_id, id - 1 AS end_id FROM l WHERE s <= id - 1")
def missing_ranges(spark, sf_dir):
    return intervals.missing_ranges(frame(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("id")), bucket=4000)


PLAN = """WITH state AS (SELECT segment_id, start_id, end_id, scan_cursor_id, CASE WHEN status IN ('in_progress', 'retry_wait') THEN 'pending' ELSE status END AS status FROM fx_segments),
swept AS (SELECT start_id, end_id, max(end_id) OVER (ORDER BY start_id, end_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM state WHERE status = 'done'),
f AS (SELECT coalesce((SELECT max(end_id) FROM swept WHERE start_id < coalesce((SELECT min(start_id) FROM swept WHERE start_id > coalesce(reached, 0) + 1), 9223372036854775807)), 0) + 1 AS first, (SELECT max(end_id) + 5000 FROM state) AS target),
c AS (SELECT start_id, end_id, max(end_id) OVER (ORDER BY start_id, end_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM state, f WHERE end_id >= first AND start_id <= target),
holes AS (SELECT greatest(coalesce(reached, first - 1), first - 1) + 1 AS lo, start_id - 1 AS hi FROM c, f UNION ALL SELECT greatest(coalesce((SELECT max(end_id) FROM c), first - 1), first - 1) + 1, target FROM f),
pieces AS (SELECT s AS start_id, least(s + 1999, hi) AS end_id FROM (SELECT unnest(range(lo, hi + 1, 2000)) AS s, hi FROM holes WHERE lo <= hi)),
full_state AS (SELECT segment_id, start_id, end_id, status, scan_cursor_id FROM state UNION ALL SELECT (SELECT max(segment_id) FROM state) + row_number() OVER (ORDER BY start_id, end_id), start_id, end_id, 'pending', NULL FROM pieces),
plan AS (SELECT segment_id, start_id, end_id, scan_cursor_id FROM full_state, f WHERE status = 'pending' AND end_id >= first AND start_id <= target)
"""


@query(oracle(PLAN + "SELECT segment_id, start_id, end_id FROM plan", "fx_segments"))
def prepare_plan(spark, sf_dir):
    return segments.prepare(_segments(spark, sf_dir), _target(spark, sf_dir), 2000)[1]


#: What became of the plan's segments, and the numbers of the run.
RUN = PLAN + """, results AS (SELECT *, CASE segment_id % 7 WHEN 0 THEN 'retry_wait' WHEN 1 THEN 'dead_letter' ELSE 'done' END AS outcome FROM plan WHERE segment_id % 10 <> 3),
attempts AS (SELECT *, CASE WHEN outcome = 'done' THEN end_id WHEN segment_id % 2 = 0 THEN start_id + 4 END AS last_durable_id FROM results),
report AS (SELECT (SELECT first - 1 FROM f) AS frontier_id, (SELECT first FROM f) AS planning_start_id, (SELECT target FROM f) AS target_max_id, (SELECT count(*) FROM pieces) AS created_segments, count(*) AS claimed_segments,
  count(*) FILTER (outcome = 'done') AS completed_segments, count(*) FILTER (outcome = 'retry_wait') AS retry_wait_segments, count(*) FILTER (outcome = 'dead_letter') AS dead_letter_segments,
  (SELECT count(*) FROM fx_segments WHERE status = 'in_progress') AS requeued_in_progress, (SELECT count(*) FROM fx_segments WHERE status = 'retry_wait') AS reactivated_retry_wait, count(*) FILTER (outcome = 'dead_letter') > 0 AS had_fatal_failures FROM results)
"""


def _run(spark, sf_dir):
    """(plan, attempts, report) of a run over the whole table."""
    before, target = _segments(spark, sf_dir), _target(spark, sf_dir)
    plan = segments.prepare(before, target, 2000)[1]
    i = F.col("segment_id")
    outcome = F.when(i % 7 == 0, "retry_wait").when(i % 7 == 1, "dead_letter").otherwise("done")
    last = F.when(F.col("outcome") == "done", F.col("end_id")).when(i % 2 == 0, F.col("start_id") + 4)
    claimed = plan.filter(i % 10 != 3).withColumn("outcome", outcome).withColumn("last_durable_id", last).join(before.select("segment_id", "scan_cursor_id"), "segment_id", "left")
    return plan, claimed, segments.run_report(before, claimed, target, 2000)


@query(oracle(RUN + "SELECT * FROM report", "fx_segments"))
def run_report(spark, sf_dir):
    return _run(spark, sf_dir)[2]


@query(oracle(RUN + """, d AS (SELECT CAST(coalesce(sum(greatest(coalesce(last_durable_id - coalesce(scan_cursor_id + 1, start_id) + 1, 0), 0)), 0) AS BIGINT) AS durable FROM attempts),
m AS (SELECT r.*, durable, (SELECT count(*) FROM plan) AS planned, greatest(target_max_id - planning_start_id + 1, 0) AS total, (SELECT count(*) FROM fx_exceptions WHERE state = 'terminal_missing') AS missing FROM report r, d)
SELECT x.metric, x.kind, x.labels, CAST(x.value AS BIGINT) AS value FROM m, LATERAL (VALUES ('catchup_segments_claimed_total', 'counter', '', claimed_segments), ('catchup_segments_completed_total', 'counter', '', completed_segments), ('catchup_segments_retry_wait_total', 'counter', '', retry_wait_segments),
  ('catchup_segments_dead_letter_total', 'counter', '', dead_letter_segments), ('catchup_terminal_missing_items_total', 'counter', '', missing), ('catchup_durable_items_total', 'counter', '', durable), ('catchup_frontier_id', 'gauge', '', frontier_id),
  ('catchup_target_max_id', 'gauge', '', target_max_id), ('catchup_pending_segments', 'gauge', '', planned), ('catchup_target_total_items', 'gauge', '', total), ('catchup_durable_items_completed', 'gauge', '', durable),
  ('catchup_progress_percent', 'gauge', '', least(durable, total) * 100 // total), ('catchup_target_is_full_history', 'gauge', '', 0), ('catchup_target_is_updater', 'gauge', '', 1), ('catchup_target_is_bounded', 'gauge', '', 0),
  ('realtime_batch_size', 'gauge', '', 5), ('realtime_records_processed_total', 'counter', '', (SELECT count(*) FROM fx_http WHERE status = 200)), ('realtime_records_failed_total', 'counter', '', (SELECT count(*) FROM fx_http WHERE status <> 200)),
  ('build_info', 'gauge', 'service="worker",version="1.0",commit="unknown"', 1)) AS x(metric, kind, labels, value)""", "fx_segments", "fx_exceptions", "fx_http"))
def metric_registry(spark, sf_dir):
    plan, attempted, report = _run(spark, sf_dir)
    missing = frame(spark, sf_dir, "fx_exceptions").filter("state = 'terminal_missing'")
    processed, failed = frame(spark, sf_dir, "fx_http").agg(F.count_if(F.col("status") == 200), F.count_if(F.col("status") != 200)).first()
    realtime = {"batch_size": 5, "records_processed": processed, "records_failed": failed}
    return metrics.registry(report, attempted, plan, missing, "updater", realtime, {"service": "worker", "version": "1.0", "commit": "unknown"})


@query(oracle("SELECT segment_id, start_id, end_id, 'in_progress' AS status, attempts + 1 AS attempts, scan_cursor_id FROM fx_segments WHERE status = 'pending' ORDER BY start_id, segment_id LIMIT 1", "fx_segments"))
def claim_next(spark, sf_dir):
    return segments.claim_next(_segments(spark, sf_dir)).select("segment_id", "start_id", "end_id", "status", "attempts", "scan_cursor_id")


@query(oracle("SELECT segment_id, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, scan_cursor_id FROM fx_segments", "fx_segments"))
def requeue(spark, sf_dir):
    return segments.requeue(_segments(spark, sf_dir), "in_progress").select("segment_id", "status", "scan_cursor_id")


@query(oracle("""WITH s AS (SELECT *, end_id >= 5000 AND start_id <= 90000 AS hit FROM fx_segments)
SELECT s.segment_id, e.item_id, CASE WHEN hit THEN 'pending' ELSE s.status END AS status, CASE WHEN NOT hit THEN s.scan_cursor_id END AS scan_cursor_id, CAST(CASE WHEN hit THEN s.end_id - s.start_id + 1 ELSE s.unresolved_count END AS INT) AS unresolved_count,
  CASE WHEN NOT hit THEN s.failure_class END AS failure_class, CASE WHEN hit AND e.item_id IS NOT NULL THEN 'pending' ELSE e.state END AS state, CAST(CASE WHEN hit AND e.item_id IS NOT NULL THEN 0 ELSE e.attempts END AS INT) AS tries
FROM s LEFT JOIN fx_exceptions e USING (segment_id)""", "fx_segments", "fx_exceptions"))
def reset_window(spark, sf_dir):
    after, exceptions = segments.reset_window(_segments(spark, sf_dir), frame(spark, sf_dir, "fx_exceptions"), 5000, 90000)
    own = exceptions.select("segment_id", "item_id", "state", F.col("attempts").alias("tries"))
    return after.join(own, "segment_id", "left").select("segment_id", "item_id", "status", "scan_cursor_id", "unresolved_count", "failure_class", "state", "tries")


@query(oracle("""WITH r AS (SELECT segment_id, CASE segment_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'retry_wait' ELSE 'dead_letter' END AS outcome, CASE WHEN segment_id % 2 = 0 THEN start_id + 4 END AS last FROM fx_segments WHERE status = 'in_progress')
SELECT s.segment_id, coalesce(outcome, status) AS status, CASE WHEN outcome = 'done' THEN end_id WHEN outcome IS NOT NULL THEN coalesce(last, scan_cursor_id) ELSE scan_cursor_id END AS scan_cursor_id,
  CAST(CASE WHEN outcome = 'done' THEN 0 WHEN outcome IS NOT NULL THEN greatest(end_id - coalesce(last + 1, start_id) + 1, 0) ELSE unresolved_count END AS INT) AS unresolved_count,
  CASE WHEN outcome = 'done' THEN NULL WHEN outcome IS NOT NULL THEN 'upstream' ELSE last_error END AS last_error, CASE WHEN outcome = 'done' THEN NULL WHEN outcome IS NOT NULL THEN 'http_4xx' ELSE failure_class END AS failure_class
FROM fx_segments s LEFT JOIN r USING (segment_id)""", "fx_segments"))
def segment_transitions(spark, sf_dir):
    own = _segments(spark, sf_dir)
    outcome = F.when(F.col("segment_id") % 3 == 0, "done").when(F.col("segment_id") % 3 == 1, "retry_wait").otherwise("dead_letter")
    results = own.filter("status = 'in_progress'").select("segment_id", outcome.alias("outcome"), F.when(F.col("segment_id") % 2 == 0, F.col("start_id") + 4).alias("last_durable_id"), F.lit("upstream").alias("error"), F.lit("http_4xx").alias("error_class"))
    return segments.apply_results(own, results).select("segment_id", "status", "scan_cursor_id", "unresolved_count", "last_error", "failure_class")


@query(oracle("SELECT segment_id, coalesce(scan_cursor_id + 1, start_id) AS next_id, scan_cursor_id IS NULL OR scan_cursor_id BETWEEN start_id - 1 AND end_id AS valid FROM fx_segments", "fx_segments"))
def segment_next_id(spark, sf_dir):
    start, end, cursor = F.col("start_id"), F.col("end_id"), F.col("scan_cursor_id")
    return _segments(spark, sf_dir).select("segment_id", sizing.next_id(start, cursor).alias("next_id"), sizing.valid_segment(start, end, cursor).alias("valid"))


@query(oracle("""WITH ids AS (SELECT segment_id, unnest(range(coalesce(scan_cursor_id + 1, start_id), end_id + 1)) AS id FROM fx_segments),
r AS (SELECT segment_id, i.id, CASE WHEN h.item_id IS NULL OR i.id % 41 = 6 THEN 'missing' WHEN i.id % 113 = 50 THEN 'retryable' WHEN i.id % 131 = 50 THEN 'fatal' ELSE 'found' END AS result FROM ids i LEFT JOIN fx_http h ON h.item_id = i.id),
f AS (SELECT *, min(CASE WHEN result IN ('retryable', 'fatal') THEN id END) OVER (PARTITION BY segment_id) AS fail FROM r),
w AS (SELECT *, count(*) FILTER (result = 'missing') OVER (PARTITION BY segment_id ORDER BY id) AS run FROM f WHERE fail IS NULL OR id <= fail),
x AS (SELECT *, count(*) FILTER (result = 'found') OVER (PARTITION BY segment_id, run ORDER BY id) AS fill FROM w),
g AS (SELECT segment_id, max(fail) AS failed_id, max(CASE WHEN result = 'missing' OR (result = 'found' AND fill % 6 = 0) THEN id END) AS durable, max(CASE WHEN id = fail THEN result END) AS res,
  count(*) FILTER (result = 'found') AS n_found, count(*) FILTER (result = 'missing') AS n_missing FROM x GROUP BY segment_id),
o AS (SELECT s.*, failed_id, coalesce(res, 'completed') AS outcome, CASE WHEN res IS NULL THEN end_id ELSE coalesce(durable, scan_cursor_id) END AS last, coalesce(n_found, 0) AS n_found, coalesce(n_missing, 0) AS n_missing FROM fx_segments s LEFT JOIN g USING (segment_id))
SELECT segment_id, outcome, last AS last_durable_id, CASE WHEN outcome = 'completed' THEN 0 ELSE greatest(end_id - coalesce(last + 1, start_id) + 1, 0) END AS unresolved, failed_id, n_found, n_missing FROM o""", "fx_segments", "fx_http"))
def segment_attempt(spark, sf_dir):
    i = F.col("item_id")
    result = F.when(i % 41 == 6, "missing").when(i % 113 == 50, "retryable").when(i % 131 == 50, "fatal").otherwise("found")
    items = frame(spark, sf_dir, "fx_http").select(i.alias("id"), result.alias("result"))
    return attempts.segment_attempts(_segments(spark, sf_dir), items, 6)


@query(oracle("""WITH t AS (SELECT item_id, [status, 429, CAST(CASE WHEN item_id % 2 = 0 THEN 200 ELSE 404 END AS INT), 500] AS s FROM fx_http),
n AS (SELECT item_id, s, unnest([1, 2, 3]) AS n FROM t), stop AS (SELECT item_id, any_value(s) AS s, coalesce(min(n) FILTER (NOT (s[n] = 429 OR s[n] BETWEEN 500 AND 599)), 3) AS n FROM n GROUP BY item_id)
SELECT item_id, CAST(n AS INT) AS attempts, s[n] AS status, CASE WHEN s[n] BETWEEN 200 AND 299 THEN 'found' WHEN s[n] = 429 OR s[n] BETWEEN 500 AND 599 THEN 'retryable' ELSE 'fatal' END AS result FROM stop""", "fx_http"))
def retry_outcome(spark, sf_dir):
    statuses = F.array(F.col("status"), F.lit(429), F.when(F.col("item_id") % 2 == 0, 200).otherwise(404), F.lit(500))
    return frame(spark, sf_dir, "fx_http").select("item_id", attempts.retry_outcome(statuses, 3).alias("r")).select("item_id", "r.*")


@query(oracle("SELECT count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'retry_wait') AS n_retry_wait, count(*) FILTER (status = 'dead_letter') AS n_dead_letter, count(*) FILTER (status = 'pending') AS n_pending, CAST(sum(unresolved_count) AS BIGINT) AS n_unresolved FROM fx_segments", "fx_segments"))
def run_summary(spark, sf_dir):
    return segments.run_summary(_segments(spark, sf_dir))


@query(oracle("""SELECT segment_id, '{"attempts":' || attempts || ',"diagnostics":null,"failure_class":"' || coalesce(failure_class, 'unknown') || '","item_id":' || item_id || ',"message":"' || last_error || '","run_id":"run-1","segment_id":' || segment_id || '}' AS payload FROM fx_exceptions""", "fx_exceptions"))
def failure_payload(spark, sf_dir):
    c = F.col
    payload = attempts.failure_payload(F.lit("run-1"), c("segment_id"), c("item_id"), c("attempts"), c("failure_class"), c("last_error"))
    return frame(spark, sf_dir, "fx_exceptions").select("segment_id", payload.alias("payload"))


@query(oracle("SELECT segment_id, CASE WHEN segment_id % 3 = 1 THEN 'pending' ELSE status END AS status, scan_cursor_id, unresolved_count, CASE WHEN segment_id % 3 <> 1 THEN last_error END AS last_error, CASE WHEN segment_id % 3 <> 1 THEN failure_class END AS failure_class FROM fx_segments", "fx_segments"))
def segment_pending(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    return segments.set_pending(rows, rows.filter("segment_id % 3 = 1")).select("segment_id", "status", "scan_cursor_id", "unresolved_count", "last_error", "failure_class")


@query(oracle("SELECT segment_id, status, CASE segment_id % 4 WHEN 0 THEN end_id WHEN 1 THEN NULL ELSE scan_cursor_id END AS scan_cursor_id, CAST(CASE WHEN segment_id % 4 < 2 THEN segment_id % 9 ELSE unresolved_count END AS INT) AS unresolved_count FROM fx_segments", "fx_segments"))
def segment_progress(spark, sf_dir):
    rows, i = _segments(spark, sf_dir), F.col("segment_id")
    progress = rows.filter(i % 4 < 2).select(i, F.when(i % 4 == 0, F.col("end_id")).alias("scan_cursor_id"), (i % 9).cast("int").alias("unresolved_count"))
    return segments.update_progress(rows, progress).select("segment_id", "status", "scan_cursor_id", "unresolved_count")


@query("""WITH e AS (SELECT event_id, event_id % 11 AS items, event_id % 2 AS kids, event_id % 5 AS bad, event_id % 7 = 3 AS broken FROM events)
SELECT event_id, CAST(CASE WHEN items = 0 THEN 0 ELSE least(bad + 1, 3) END AS INT) AS attempts,
  CASE WHEN items = 0 AND kids = 0 THEN 'nothing' WHEN items = 0 THEN 'fatal' WHEN bad > 2 THEN 'retryable' WHEN broken THEN 'fatal' ELSE 'written' END AS result,
  CASE WHEN items = 0 AND kids = 0 THEN NULL WHEN items = 0 THEN 'schema' WHEN bad > 2 THEN 'network_transient' WHEN broken THEN 'schema' END AS failure_class FROM e""")
def flush_outcome(spark, sf_dir):
    i = F.col("event_id")
    errors = F.concat(F.array_repeat(F.lit(classify.RETRYABLE_DB[0]), (i % 5).cast("int")), F.array(F.when(i % 7 == 3, "UniqueViolation")))
    return frame(spark, sf_dir, "events").select("event_id", attempts.flush_outcome(i % 11, i % 2, errors, 3).alias("r")).select("event_id", "r.*")


@query(oracle("""WITH t AS (SELECT item_id, status, status = 429 OR status >= 500 AS again, item_id % 4 <> 0 AS body FROM fx_http)
SELECT item_id, CAST(CASE WHEN again AND NOT body THEN 2 ELSE 1 END AS INT) AS attempts, CASE WHEN again OR status = 200 THEN CASE WHEN body THEN 'succeeded' ELSE 'missing' END ELSE 'fatal' END AS result,
  CASE WHEN again OR status = 200 THEN NULL WHEN status >= 400 THEN 'http_4xx' ELSE 'schema' END AS failure_class FROM t""", "fx_http"))
def realtime_item(spark, sf_dir):
    outcome = attempts.realtime_outcome(F.array("status"), F.col("item_id") % 4 != 0, 3)
    return frame(spark, sf_dir, "fx_http").select("item_id", outcome.alias("r")).select("item_id", "r.*")
