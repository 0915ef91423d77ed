import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import classify, sizing, text
from threadloom.operators import attempts, intervals, lineage, segments, upsert
from threadloom.sources import items as item_source
from threadloom.sources.schemas import EXCEPTIONS, SEGMENTS


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def states(spark, *rows):
    return spark.createDataFrame([(i + 1, a, b, status, 1, None, b - a + 1, None, None) for i, (a, b, status) in enumerate(rows)], SEGMENTS)


def pairs(df):
    return sorted((r["start_id"], r["end_id"]) for r in df.collect())


STATUSES = ("pending", "in_progress", "retry_wait", "done", "dead_letter")


def random_segments(seed):
    """Segments cut at random from a stretch of ids, some left out, each with a status."""
    rng = random.Random(seed)
    cuts = sorted({0, *rng.sample(range(1, 90), rng.randint(0, 9)), 90})
    return [(a + 1, b, rng.choice(STATUSES)) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.8]


def covered(rows, *statuses):
    return {i for a, b, status in rows if status in (statuses or STATUSES) for i in range(a, b + 1)}


def frontier_of(rows):
    done, last = covered(rows, "done"), 0
    while last + 1 in done:
        last += 1
    return last


def plan_of(rows, target, width, start):
    """What is pending once unfinished segments are requeued and each hole is cut into pieces of the width."""
    plan = [(a, b) for a, b, status in rows if status in ("pending", "in_progress", "retry_wait") and b >= start and a <= target]
    free = [i for i in range(start, target + 1) if i not in covered(rows)]
    while free:
        size = 1
        while size < min(width, len(free)) and free[size] == free[0] + size:
            size += 1
        plan.append((free[0], free[size - 1]))
        free = free[size:]
    return sorted(plan)


@pytest.mark.parametrize("seed", range(6))
def test_frontier_and_plan_equal_a_walk_over_ids(spark, seed):
    rng, rows = random.Random(100 + seed), random_segments(seed)
    table = states(spark, *rows) if rows else spark.createDataFrame([], SEGMENTS)
    assert intervals.frontier(table.filter("status = 'done'")).first()[0] == frontier_of(rows)
    target, width, cold = rng.randint(60, 120), rng.randint(1, 40), rng.choice([None, rng.randint(1, 50)])
    start, plan = segments.prepare(table, target, width, cold_start=cold)
    assert start == (cold or frontier_of(rows) + 1) and pairs(plan) == plan_of(rows, target, width, start)


def test_plan_of_an_empty_table_and_of_dead_letters_alone(spark):
    start, plan = segments.prepare(spark.createDataFrame([], SEGMENTS), 7, 3)
    assert start == 1 and pairs(plan) == [(1, 3), (4, 6), (7, 7)]
    start, plan = segments.prepare(states(spark, (1, 7, "dead_letter")), 7, 3)
    assert start == 1 and pairs(plan) == []


def test_new_segments_are_numbered_in_order_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(segments, "NUMBERED", 10)
    ranges = spark.createDataFrame([(k, k) for k in random.Random(0).sample(range(100, 200), 60)], "start_id long, end_id long")
    new = segments.enqueue(states(spark, (1, 5, "done"), (6, 9, "done")), ranges).filter("start_id >= 100").orderBy("segment_id").collect()
    assert [r["segment_id"] for r in new] == list(range(3, 63)) and [r["start_id"] for r in new] == sorted(r["start_id"] for r in new)


@pytest.mark.parametrize("arguments", [(0, 10, None), (10, 0, None), (10, 10, 0)])
def test_plan_rejects_bad_input(spark, arguments):
    target, width, cold = arguments
    with pytest.raises(ValueError):
        segments.prepare(spark.createDataFrame([], SEGMENTS), target, width, cold)


@pytest.mark.parametrize("seed", range(3))
def test_replay_resets_what_touches_the_window(spark, seed):
    rng, rows = random.Random(seed), [(k, k + 4, STATUSES[k % 5]) for k in range(1, 60, 6)]
    low = rng.randint(1, 40)
    high = low + rng.randint(0, 15)
    failed = [(k + 1, a + 2, rng.choice(["retry_wait", "dead_letter"]), 3, "x", "http_4xx") for k, (a, _, _) in enumerate(rows) if rng.random() < 0.6]
    hit = {k + 1 for k, (a, b, _) in enumerate(rows) if b >= low and a <= high}
    after, exceptions = segments.reset_window(states(spark, *rows), spark.createDataFrame(failed, EXCEPTIONS), low, high)
    assert {r["segment_id"]: (r["status"], r["unresolved_count"]) for r in after.collect()} == {k + 1: ("pending" if k + 1 in hit else s, 5) for k, (_, _, s) in enumerate(rows)}
    assert {r["segment_id"]: (r["state"], r["attempts"], r["last_error"]) for r in exceptions.collect()} == {f[0]: ("pending", 0, None) if f[0] in hit else (f[2], 3, "x") for f in failed}


def test_claim_counts_attempts_and_clears_errors(spark):
    claimed = segments.claim_next(states(spark, (5, 9, "pending"), (1, 4, "pending"))).first()
    assert (claimed["start_id"], claimed["status"], claimed["attempts"]) == (1, "in_progress", 2)


def test_missing_ranges_and_their_neighbours(spark):
    ids = spark.createDataFrame([(3,), (4,), (9,)], "id long")
    found = lambda **options: sorted(map(tuple, intervals.missing_ranges(ids, bucket=4, **options).collect()))
    assert found() == [(1, 2), (5, 8)] and found(legacy_expand=True) == [(0, 3), (4, 9)]


def test_limits_must_be_positive(spark):
    with pytest.raises(ValueError):
        segments.by_status(states(spark, (1, 2, "done")), "done", 0)
    with pytest.raises(ValueError):
        intervals.enqueue_range(1, 5, 0, spark)
    assert intervals.enqueue_range(5, 1, 3, spark).count() == 0


def test_checks_find_unknown_status_and_reversed_range(spark):
    found = upsert.violations(states(spark, (1, 2, "not_real"), (10, 1, "done")), segments.checks()).collect()
    assert sorted(r["violated"][0] for r in found) == ["start_before_end", "status_known"]


def attempt(spark, start, end, results, batch=2, cursor=None):
    work = spark.createDataFrame([(1, start, end, cursor)], "segment_id long, start_id long, end_id long, scan_cursor_id long")
    return attempts.segment_attempts(work, spark.createDataFrame(results, "id long, result string"), batch).first().asDict()


def folded(start, end, result_of, batch, cursor):
    """One attempt, an id at a time."""
    next_id = start if cursor is None or cursor < start else cursor + 1
    last, fill, seen = cursor if cursor is not None and cursor >= start else None, 0, Counter()
    for i in range(next_id, end + 1):
        result = result_of.get(i, "missing")
        if result in ("retryable", "fatal"):
            return result, last, end - (last + 1 if last is not None else start) + 1, i, seen["found"], seen["missing"]
        seen[result] += 1
        if result == "missing":
            last, fill = i, 0
        else:
            fill += 1
            if fill == batch:
                last, fill = i, 0
    return "completed", end, 0, None, seen["found"], seen["missing"]


def test_attempts_equal_a_fold_over_ids(spark):
    rng = random.Random(4)
    kinds = ["found"] * 12 + ["missing"] * 3 + ["retryable", "fatal"]
    items = {i: rng.choice(kinds) for i in range(1, 700) if rng.random() < 0.9}
    work = []
    for k in range(60):
        start = 1 + 11 * k
        work.append((k, start, start + rng.randint(0, 10), rng.choice([None, None, start - 1, start])))
    for batch in (1, 3):
        got = attempts.segment_attempts(spark.createDataFrame(work, "segment_id long, start_id long, end_id long, scan_cursor_id long"), spark.createDataFrame(list(items.items()), "id long, result string"), batch)
        found = {r["segment_id"]: tuple(r)[1:] for r in got.collect()}
        assert found == {k: folded(a, b, items, batch, c) for k, a, b, c in work}


def test_wide_segments_fold_over_stretches(spark, monkeypatch):
    """Stretches of seven ids: batches, missing runs and failures cross them."""
    monkeypatch.setattr(attempts, "STRETCH", 7)
    rng, work, items = random.Random(9), [], {}
    for k in range(24):
        start = 1 + 200 * k
        work.append((k, start, start + rng.randint(60, 180), rng.choice([None, start + 20])))
        kinds = rng.choice([["found"], ["found"] * 30 + ["missing"], ["found"] * 60 + ["missing", "fatal"], ["found"] * 5 + ["missing"]])
        items |= {i: rng.choice(kinds) for i in range(start, start + 200)}
    for batch in (4, 11, 50):
        got = attempts.segment_attempts(spark.createDataFrame(work, "segment_id long, start_id long, end_id long, scan_cursor_id long"), spark.createDataFrame(list(items.items()), "id long, result string"), batch)
        assert {r["segment_id"]: tuple(r)[1:] for r in got.collect()} == {k: folded(a, b, items, batch, c) for k, a, b, c in work}


def test_one_segment_of_a_million_ids_is_many_tasks(spark):
    work = spark.createDataFrame([(1, 1, 1_000_000, None)], "segment_id long, start_id long, end_id long, scan_cursor_id long")
    items = spark.range(1, 1_000_001).selectExpr("id", "CASE WHEN id = 777777 THEN 'fatal' WHEN id = 500000 THEN 'missing' ELSE 'found' END AS result")
    got = attempts.segment_attempts(work, items, 64).first()
    durable = 500_000 + (777_776 - 500_000) // 64 * 64
    assert tuple(got) == (1, "fatal", durable, 1_000_000 - durable, 777_777, 777_775, 1)


def test_ids_without_a_row_are_counted_and_not_listed(spark):
    """Two thousand million ids, of which three have a row: listing them would not end."""
    work = spark.createDataFrame([(1, 1, 2_000_000_000, None), (2, 5, 30, 9)], "segment_id long, start_id long, end_id long, scan_cursor_id long")
    items = spark.createDataFrame([(12, "found"), (1_500_000_000, "found"), (1_500_000_001, "fatal")], "id long, result string")
    got = sorted(map(tuple, attempts.segment_attempts(work, items, 1).collect()))
    assert got == [(1, "fatal", 1_500_000_000, 500_000_000, 1_500_000_001, 2, 1_499_999_998), (2, "completed", 30, 0, None, 1, 20)]


def test_malformed_and_finished_segments(spark):
    assert attempt(spark, 10, 5, [])["outcome"] == "fatal"
    assert attempt(spark, 1, 5, [(1, "found")], cursor=5) | {"failed_id": None} == {"segment_id": 1, "outcome": "completed", "last_durable_id": 5, "unresolved": 0, "failed_id": None, "n_found": 0, "n_missing": 0}


def test_retries_stop_at_success_or_fatal(spark):
    run = lambda *statuses: one(spark, attempts.retry_outcome(F.array(*map(F.lit, statuses)), 3)).asDict()
    assert run(429, 503, 200) == {"attempts": 3, "status": 200, "result": "found"}
    assert run(401)["result"] == "fatal" and run(401)["attempts"] == 1
    assert run(503, 503, 503, 200) == {"attempts": 3, "status": 503, "result": "retryable"}


def test_last_write_wins(spark):
    rows = spark.createDataFrame([(100, "first", 0), (100, "second", 1), (101, "third", 2)], "id long, title string, seq long")
    assert sorted(tuple(r) for r in upsert.last_per_key(rows, ["id"], ["seq"]).select("id", "title").collect()) == [(100, "second"), (101, "third")]
    assert upsert.duplicates(rows, ["id"]).first()[0] == 1


def test_batches_of_edges_alone_are_an_error(spark):
    none, some = spark.range(0), spark.range(1)
    assert not upsert.check_batch(none, none) and upsert.check_batch(some, none)
    with pytest.raises(ValueError):
        upsert.check_batch(none, some)


def story_of(i, batch, stored):
    """Follows parents within the batch; a stored parent helps once."""
    seen = set()
    while i not in seen:
        seen.add(i)
        if i not in batch:
            kind, _, story = stored.get(i, (None, None, None))
            return i if kind == "story" else story
        kind, parent, story = batch[i]
        if kind == "story":
            return i
        if kind != "comment":
            return None
        if story is not None:
            return story
        if parent is None:
            return None
        i = parent
    return None


@pytest.mark.parametrize("seed", range(4))
def test_lineage_inside_a_batch_equals_following_parents(spark, seed):
    rng = random.Random(seed)

    def row(i):
        kind = rng.choices(["story", "comment", "poll"], [2, 9, 1])[0]
        return kind, rng.choice([None, *range(1, 41)]) if kind == "comment" else None, rng.choice([None] * 6 + [rng.randint(1, 40)])

    batch, stored = ({i: row(i) for i in rng.sample(range(1, 41), 22)} for _ in range(2))
    schema = "id long, type string, parent long, story_id long"
    frames = (spark.createDataFrame([(i, *r) for i, r in rows.items()], schema) for rows in (batch, stored))
    got = {r["id"]: r["story_id"] for r in lineage.resolve(*frames).collect()}
    assert got == {i: story_of(i, batch, stored) for i in batch}


def test_cycles_of_parents_end_the_rounds(spark):
    rows = [(1, "story", None, None), (2, "comment", 1, None), (3, "comment", 5, None), (4, "comment", 3, None), (5, "comment", 4, None), (6, "comment", 5, None)]
    got = lineage.backfill(spark.createDataFrame(rows, "id long, type string, parent long, story_id long"))
    assert {r["id"]: r["story_id"] for r in got.collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_backfill_follows_long_chains(spark):
    rows = [(1, "story", None, None)] + [(k, "comment", k - 1, None) for k in range(2, 200)]
    got = lineage.backfill(spark.createDataFrame(rows, "id long, type string, parent long, story_id long"))
    assert got.filter("story_id = 1").count() == 199


def test_payload_decoding(spark):
    raw = ['{"id":1,"type":"story","by":"a","extra":5}', '{"id":2,"deleted":[true],"dead":[],"type":"story"}', "{", '{"id":3,"kids":["x"]}', "null", '{"type":"story"}', '{"id":4,"dead":"maybe","deleted":[[1]]}']
    df = spark.createDataFrame([(k, p) for k, p in enumerate(raw)], "k int, payload string")
    got = {r["k"]: r for r in item_source.decode_items(df).collect()}
    assert got[0]["item"]["by"] == "a" and (got[1]["item"]["deleted"], got[1]["item"]["dead"]) == (True, None)
    assert [got[k]["failure_class"] for k in range(7)] == [None, None, "decode", "decode", None, "decode", None]
    assert got[4]["item"] is None and (got[6]["item"]["deleted"], got[6]["item"]["dead"]) == (True, None)


def test_items_from_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":3,"type":"story","title":"a\\u0000b"}\n{"x":1}\n')
    got = item_source.decode_items(item_source.fetched(spark, 2, 3, item_source.json_lines(spark, str(tmp_path))))
    assert [(r["id"], r["title"], r["domain"]) for r in item_source.item_rows(got).collect()] == [(3, "ab", None)]


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [((1000, 500, 700, 200, None, False), 899), ((1000, 500, 950, 200, None, False), 1000), ((50000, 20000, None, None, None, False), 50000), ((50000, 20000, 1, None, 100000, True), 100000)],
)
def test_target(spark, arguments, expected):
    *numbers, ignore = arguments
    columns = [F.lit(x).cast("long") for x in numbers]
    assert one(spark, sizing.target_max(*columns, F.lit(ignore))) == expected


def test_sizes(spark):
    lit = F.lit
    assert [one(spark, sizing.target_total(lit(a), lit(b))) for a, b in ((10, 9), (10, 10), (10, 12))] == [0, 1, 3]
    assert one(spark, sizing.derive_workers(lit(250))) == 24
    assert one(spark, sizing.queue_capacity(lit(24))) == 48 and one(spark, sizing.pool_size(lit(225))) == 64
    assert one(spark, sizing.throttle_pause(lit(2.0), lit(0.5))) == 2.0 and one(spark, sizing.throttle_pause(lit(2.0), lit(1.0))) is None
    for bad in ({"limit": 0}, {"limit": 1, "end": 2}, {"cold_start": 5, "end": 4}, {"ignore_highest": True}):
        with pytest.raises(ValueError):
            sizing.check_inputs(**bad)


def test_texts(spark):
    assert one(spark, text.escape_html(F.lit("<broken> & 'x'"))) == "&lt;broken&gt; &amp; &#39;x&#39;"
    urls = {"http:///p": "http", "a@b@c": "b@c", "//x/y": None, "http://[::1]/": "[", "  ": None, "https://u:p@Host.Example:80/x": "host.example"}
    assert {u: one(spark, text.url_domain(F.lit(u))) for u in urls} == urls
    assert str(one(spark, text.item_day(F.lit(-1)))) == "1969-12-31"
    assert one(spark, text.relative_age(F.lit(0), F.lit(2592000))) == "30 days ago" and one(spark, text.relative_age(F.lit(0), F.lit(2592001))) == "1 month ago"
    assert one(spark, classify.default_class(F.lit("RateLimited"))) == "network_transient"


def test_unknown_names_raise(spark):
    with pytest.raises(Exception, match="invalid status"):
        one(spark, classify.checked(F.lit("nope"), ("done",), "status"))
