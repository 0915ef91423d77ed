"""Logs, their metrics, JSON walks and the outcomes that have no table of their own, on odd input."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import attempts, export, jsonwalk, logs, metrics, segments, upsert

LINES = "unit string, seq long, line string"


def test_lines_that_are_no_json_or_lack_fields(spark):
    rows = [("backfill-a.service", 1, None), ("backfill-a.service", 2, "{"), ("backfill-a.service", 3, '{"event":"progress","timestamp":"never"}'), (None, 4, "{}"), ("backfill-a.service2", 5, "{}")]
    got = {r["seq"]: r for r in logs.read(logs.kept(spark.createDataFrame(rows, LINES))).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[k]["event"] for k in (1, 2, 3)] == [None, None, "progress"]
    assert all(got[k]["t"] is None and got[k]["run_id"] is None for k in got)


def test_a_gauge_keeps_its_last_value_over_lines_without_it(spark):
    rows = [("a", 1, 10, 7, None), ("a", 2, 10, 5, 40), ("a", 3, 20, None, 60), ("a", 4, 30, None, None), (None, 5, 40, 1, 1)]
    log = spark.createDataFrame(rows, "run_id string, seq long, t long, pending_segments long, progress_percent long")
    assert [tuple(r) for r in logs.gauges(log).collect()] == [("a", 5, 60)]


def test_counters_of_an_empty_log(spark):
    assert logs.counters(logs.read(spark.createDataFrame([], LINES))).count() == 0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [({1: None, 2: "{", 3: "3", 4: '"x"', 5: '{"b":["p",{"c":"q"}],"a":"r"}', 6: "[" * 12 + '"d"' + "]" * 12, 7: "[]"}, [(4, "$", "x"), (5, "$.a", "r"), (5, "$.b[0]", "p"), (5, "$.b[1].c", "q"), (6, "$" + "[0]" * 12, "d")])],
)
def test_strings_of_json_texts(spark, raw, expected):
    found = jsonwalk.json_strings(spark.createDataFrame(list(raw.items()), "k long, raw string"), ["k"], "raw")
    assert sorted(map(tuple, found.collect())) == expected
    assert "Python" not in found._jdf.queryExecution().toString()


def test_pretty_json(spark):
    values = [{"b": 1, "a": {"d": [], "c": None, "e": {}}}, [1, [2, "x,y[{]}:\\\""], {"k": ["", "\u00e9"]}], "s", 3, [], {"a: b": "c: {d}"}, [[[]]], {"x": ["y"]}, True]
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)], "k long, raw string")
    got = {r["k"]: r["p"] for r in rows.select("k", text.pretty_json(F.col("raw")).alias("p")).collect()}
    assert got == {k: json.dumps(v, ensure_ascii=False, indent=2, sort_keys=True) for k, v in enumerate(values)}
    assert spark.createDataFrame([("{",), (None,)], "raw string").select(text.pretty_json(F.col("raw"))).collect() == [(None,), (None,)]


def test_sorted_json(spark):
    rows = spark.createDataFrame([('{"b":1,"a":{"d":[],"c":null}}',), ("{",), (None,)], "raw string").select(text.sorted_json(F.col("raw"))).collect()
    assert [r[0] for r in rows] == ['{"a":{"c":null,"d":[]},"b":1}', None, None]


def test_a_negative_count_is_an_error(spark):
    rows = spark.createDataFrame([(1, 3, 5), (2, None, 6)], "segment_id long, scan_cursor_id long, unresolved_count int")
    after = segments.update_progress(rows, spark.createDataFrame([(1, None, 0)], rows.schema))
    assert sorted(map(tuple, after.collect())) == [(1, None, 0), (2, None, 6)]
    with pytest.raises(Exception, match="must not be negative"):
        segments.update_progress(rows, spark.createDataFrame([(1, 4, -1)], rows.schema)).collect()


@pytest.mark.parametrize(
    ("n_items", "n_kids", "errors", "expected"),
    [
        (0, 0, [], (0, "nothing", None)), (0, 2, [], (0, "fatal", "schema")), (1, 0, [], (1, "written", None)), (1, 1, ["ClosedConnection"], (2, "written", None)),
        (1, 1, ["ClosedConnection", "Other"], (2, "fatal", "schema")), (1, 1, ["ClosedConnection"] * 5, (2, "retryable", "network_transient")),
    ],
)
def test_flush(spark, n_items, n_kids, errors, expected):
    row = spark.createDataFrame([(n_items, n_kids, errors)], "i int, k int, e array<string>")
    assert tuple(row.select(attempts.flush_outcome(F.col("i"), F.col("k"), F.col("e"), 2).alias("r")).first()["r"]) == expected


def test_changed_rows(spark):
    schema = "k long, v string"
    table = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "d")], schema)
    batch = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None), (5, None)], schema)
    assert sorted(r["k"] for r in upsert.changed(table, batch, ["k"]).collect()) == [3, 4, 5]


def plain_rate(points, at, seconds):
    """The rate of one series [(t, value)] at a time, stated directly."""
    inside = [(t, v) for t, v in points if at - seconds < t <= at]
    if len(inside) < 2:
        return None
    (t0, v0), (t1, v1) = inside[0], inside[-1]
    increase = v1 - v0 + sum(a for (_, a), (_, b) in zip(inside, inside[1:], strict=False) if b < a)
    gap = (t1 - t0) / (len(inside) - 1)
    start, end = t0 - (at - seconds), at - t1
    start = gap / 2 if start >= 1.1 * gap else start
    if increase > 0 and v0 >= 0:
        start = min(start, (t1 - t0) * v0 / increase)
    end = gap / 2 if end >= 1.1 * gap else end
    return increase * (t1 - t0 + start + end) / (t1 - t0) / seconds


def test_rates_of_sparse_resetting_and_edge_samples(spark):
    series = {
        "steady": [(k * 30, k * 5.0) for k in range(40)], "resets": [(k * 17 + 3, float((k * 3) % 20)) for k in range(80)], "sparse": [(0, 1.0), (299, 4.0), (900, 5.0), (1260, 9.0)],
        "flat": [(k * 60, 2.0) for k in range(9)], "zero": [(100, 0.0), (200, 50.0), (280, 51.0)], "edge": [(300, 1.0), (600, 3.0), (601, 4.0), (-290, 0.0), (-10, 2.0)], "one": [(5, 5.0)],
    }
    rows = [(name, t, v) for name, points in series.items() for t, v in points]
    got = {(r["series"], r["t"]): r["rate"] for r in metrics.rate(spark.createDataFrame(rows, "series string, t long, value double")).collect()}
    expected = {}
    for name, points in series.items():
        for at in range(-600, 2400, 60):
            value = plain_rate(sorted(points), at, 300)
            if value is not None:
                expected[name, at] = pytest.approx(value, abs=1e-12)
    assert got == expected


def test_a_ratio_has_a_floor(spark):
    rates = lambda *rows: spark.createDataFrame(rows, "run string, t long, rate double")
    found = metrics.rate_ratio(rates(("a", 0, 3.0), ("a", 60, 3.0), ("b", 0, 1.0)), rates(("a", 0, 6.0), ("a", 60, 0.5)), ("run",))
    assert sorted((r["t"], r["ratio"]) for r in found.collect()) == [(0, 0.5), (60, 3.0)]


def test_shards_hold_equal_bytes_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "repeat('x', CAST(id % 200 AS INT)) AS text", "CASE WHEN id % 2 = 0 THEN array(id, id) END AS parts", "named_struct('a', true, 'b', 'yy') AS s")
    sizes = {r["id"]: r["n"] for r in rows.select("id", export.row_bytes(rows.schema).alias("n")).collect()}
    assert sizes[0] == 8 + 4 + 4 + 16 + 1 + 6 and sizes[13] == 8 + 17 + 0 + 1 + 6
    done = export.export(rows, str(tmp_path / "t"), ["id"], shard_bytes=50_000)
    assert done == export.Exported(3000, sum(sizes.values()), -(-sum(sizes.values()) // 50_000))
    back = spark.read.parquet(str(tmp_path / "t"))
    shards = {}
    for r in back.select("id", "shard", F.input_file_name().alias("file")).collect():
        shards.setdefault((r["shard"], r["file"]), []).append(r["id"])
    assert sorted(k for k, _ in shards) == list(range(done.shards))
    for (k, _), ids in shards.items():
        assert abs(sum(sizes[i] for i in ids) - done.bytes / done.shards) < 0.1 * done.bytes / done.shards
        assert max(ids) - min(ids) + 1 == len(ids) and all(max(ids) < min(other) for (j, _), other in shards.items() if j > k)
    assert back.drop("shard").exceptAll(rows).isEmpty() and back.count() == 3000


def test_a_dry_export_writes_nothing_and_jobs_run_one_at_a_time(spark, tmp_path):
    rows = spark.range(10)
    job = export.ExportJob()
    assert job.run({"a": (rows, ["id"])}, str(tmp_path), dry_run=True) == {"a": export.Exported(10, 80, 1)} and list(tmp_path.iterdir()) == [] and job.state == "finished"
    assert job.run({"a": (rows.limit(0), ["id"])}, str(tmp_path))["a"] == export.Exported(0, 0, 0)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 0
    with pytest.raises(Exception, match="missing"):
        job.run({"a": (rows, ["missing"])}, str(tmp_path))
    assert job.state == "failed" and "missing" in job.error
    job.state = "running"
    with pytest.raises(RuntimeError):
        job.run({}, str(tmp_path))
