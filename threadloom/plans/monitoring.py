"""Queries on structured logs and the metrics that they carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import logs, metrics
from threadloom.plans.fixtures import frame, oracle
from threadloom.plans.registry import query
from threadloom.plans.tables import RATES

LOG = r"""WITH k AS (SELECT seq, unit, CASE WHEN json_valid(line) THEN line END AS line FROM fx_log WHERE regexp_full_match(unit, '(catchup-worker-.+|backfill-.+)\.service')),
x AS (SELECT seq, unit, line ->> '$.event' AS event, coalesce(line ->> '$.run_id', line ->> '$.span.run_id') AS run_id,
  1770940800 + CAST(substr(line ->> '$.timestamp', 12, 2) AS BIGINT) * 3600 + CAST(substr(line ->> '$.timestamp', 15, 2) AS BIGINT) * 60 + 30 AS t,
  CAST(line ->> '$.pending_segments' AS BIGINT) AS pending_segments, CAST(line ->> '$.progress_percent' AS BIGINT) AS progress_percent FROM k)
"""
STEPS = LOG + """, n AS (SELECT run_id, t - 30 AS t, count(*) FILTER (event = 'segment_claimed') AS claimed, count(*) FILTER (event = 'segment_completed') AS completed,
  count(*) FILTER (event = 'segment_retry_wait') AS retry_wait, count(*) FILTER (event = 'segment_dead_letter') AS dead_letter FROM x WHERE event LIKE 'segment_%' GROUP BY ALL)
"""


def _log(spark, sf_dir):
    return logs.read(logs.kept(frame(spark, sf_dir, "fx_log")))


@query(oracle(LOG + "SELECT seq, unit, event, run_id, t FROM x", "fx_log"))
def log_lines(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", "unit", "event", "run_id", "t")


@query(oracle(STEPS + "SELECT run_id, t, CAST(sum(claimed) OVER w AS BIGINT) AS claimed, CAST(sum(completed) OVER w AS BIGINT) AS completed FROM n WINDOW w AS (PARTITION BY run_id ORDER BY t)", "fx_log"))
def counter_series(spark, sf_dir):
    return logs.counters(_log(spark, sf_dir)).select("run_id", "t", "claimed", "completed")


@query(oracle(STEPS + "SELECT run_id, t, CAST(sum(retry_wait + dead_letter) OVER (PARTITION BY run_id ORDER BY t) AS BIGINT) AS failed FROM n", "fx_log"))
def failed_series(spark, sf_dir):
    return logs.counters(_log(spark, sf_dir)).select("run_id", "t", (F.col("retry_wait") + F.col("dead_letter")).alias("failed"))


@query(oracle(LOG + "SELECT run_id, last(pending_segments ORDER BY t, seq) AS pending_segments, last(progress_percent ORDER BY t, seq) AS progress_percent FROM x WHERE event = 'progress' GROUP BY run_id", "fx_log"))
def gauge_last(spark, sf_dir):
    return logs.gauges(_log(spark, sf_dir))


@query(oracle("""WITH b AS (SELECT CAST(floor(item_id / 7) AS BIGINT) AS batch_id, count(*) AS size, count(*) FILTER (status = 200) AS ok FROM fx_http GROUP BY 1)
SELECT CAST(floor(batch_id / 60) AS BIGINT) AS "window", count(*) AS n_batches, max(size) AS largest, CAST(sum(ok) AS BIGINT) AS records_pulled, CAST(sum(size - ok) AS BIGINT) AS records_failed FROM b GROUP BY 1""", "fx_http"))
def realtime_counters(spark, sf_dir):
    return logs.realtime_counters(frame(spark, sf_dir, "fx_http").select(F.floor(F.col("item_id") / 7).alias("batch_id"), (F.col("status") == 200).alias("ok")), 60)


RATIOS = STEPS + """, c AS (SELECT run_id, t, sum(claimed) OVER w AS claimed, sum(retry_wait) OVER w AS retry_wait, sum(dead_letter) OVER w AS dead_letter FROM n WINDOW w AS (PARTITION BY run_id ORDER BY t)),
s AS (SELECT run_id || '/' || name AS series, t, CAST(value AS DOUBLE) AS value FROM (UNPIVOT c ON claimed, retry_wait, dead_letter INTO NAME name VALUE value))
"""


@query(oracle(RATIOS + RATES + """, rated AS (SELECT split_part(series, '/', 1) AS run_id, split_part(series, '/', 2) AS name, t, rate FROM r)
SELECT a.run_id, a.name, a.t, round(a.rate / greatest(b.rate, 1), 9) AS ratio FROM rated a JOIN rated b ON a.run_id = b.run_id AND a.t = b.t AND b.name = 'claimed' WHERE a.name <> 'claimed'""", "fx_log"))
def failure_ratio(spark, sf_dir):
    """Retries and dead letters a second over claims a second, by run."""
    series = logs.counters(_log(spark, sf_dir)).unpivot(["run_id", "t"], ["claimed", "retry_wait", "dead_letter"], "name", "value")
    rates = metrics.rate(series, by=("run_id", "name"))
    ratios = metrics.rate_ratio(rates.filter("name <> 'claimed'"), rates.filter("name = 'claimed'"), ("run_id",))
    return ratios.select("run_id", "name", "t", F.round("ratio", 9).alias("ratio"))
