"""The event source, the bucketed snapshot, the item source and the counters, over more than one batch and over restarts."""

import random
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadloom.sources import events, item_source
from threadloom.sources.scratch import Scratch
from threadloom.streaming import updates
from threadloom.streaming.counters import Counters
from threadloom.streaming.snapshot import Snapshot

def test_a_change_stream_survives_restart_and_replay(spark, tmp_path):
    """Three runs over a growing folder, each with a Scratch of its own, the second one repeated as if its progress had been lost."""
    schema, name = "id long, value string, seq long", uuid.uuid4().hex
    batches = [[(1, "a", 1), (2, "b", 1), (1, "c", 2)], [(2, "d", 3), (3, "e", 3)], [(4, "f", 4), (1, "g", 4)]]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        scratch = Scratch(spark, keep=name)
        return scratch, {r["id"]: r["value"] for r in updates.latest_by_key(stream, scratch, "latest", ["id"], ["seq"], buckets=4).collect()}

    expected = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        expected |= {i: v for i, v, _ in sorted(rows, key=lambda r: r[2])}
        scratch, got = run()
        assert got == expected
        if k == 1:  # the batch was applied, but the commit of its progress was lost
            scratch.drop("latest-progress/commits/1", "latest-progress/commits/.1.crc")
            assert run()[1] == expected
    assert run()[1] == expected
    scratch.clear()



def sse(kind, data, number=None):
    lines = ([f"id: {number}"] if number is not None else []) + ([f"event: {kind}"] if kind else []) + [f"data: {x}" for x in data.split("\n")]
    return "\n".join(lines) + "\n\n"


@pytest.mark.parametrize("seed", range(6))
def test_spans_of_any_cut_give_each_event_once(tmp_path, seed):
    rng, text, expected = random.Random(seed), "\n" * seed, []
    for k in range(60):
        if rng.random() < 0.2:
            text += rng.choice([": quiet\n\n", "event: x\n\n", "\n", "retry: 5\n\n"])
        data = rng.choice(["a", "é…\nb", "", "x" * 50])
        text += sse(rng.choice(["put", None]), data, k) + "\n" * rng.randint(0, 3)
        expected.append((str(k), data))
    body = text.encode()
    (tmp_path / "log").write_bytes(body + b"event: put\ndata: not whole")
    cuts = sorted({0, len(body), *(rng.randint(0, len(body)) for _ in range(rng.randint(0, 30)))})
    rows = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in events.read_span(events.Span(str(tmp_path), "log", a, b), step=rng.choice([1, 7, 1000]))]
    assert [(r[2], r[4]) for r in rows] == expected
    assert all(body[r[1] - 1 : r[1]] in (b"", b"\n") for r in rows)


def test_offsets_end_after_whole_events_within_the_bound(tmp_path):
    body = "".join(sse("put", "x" * (k % 40)) for k in range(50)).encode()
    (tmp_path / "a").write_bytes(body)
    (tmp_path / "b").write_bytes(body + b"data: half")
    reader, seen, steps = events.EventReader({"path": str(tmp_path), "max_bytes": "300"}), {}, 0
    while (after := reader.latestOffset()) != seen:
        assert 0 < sum(after.values()) - sum(seen.values()) <= 300
        assert all(body[: after[f]].endswith(b"\n\n") for f in after)
        reader.partitions(seen, after)
        seen, steps = after, steps + 1
    assert seen == {"a": len(body), "b": len(body)} and steps >= 2 * len(body) // 300
    assert events.EventReader({"path": str(tmp_path), "max_bytes": "5"}).latestOffset()["a"] == body.index(b"\n\n") + 2


def test_stream_goes_on_after_a_restart_and_as_files_grow(spark, tmp_path):
    scratch = Scratch(spark)

    def run():
        stream = events.events(spark, str(tmp_path), max_bytes=200, task_bytes=64).select("id", "data")
        rows = updates.run_to_table(stream, scratch, "seen")
        return sorted((int(r["id"]), r["data"]) for r in rows.collect())

    text = "".join(sse("put", f"x{k}", k) for k in range(40))
    (tmp_path / "log").write_text(text + "id: 40\ndata: cut")
    assert run() == [(k, f"x{k}") for k in range(40)]
    assert spark.read.parquet(scratch.path("seen")).count() == 40
    (tmp_path / "log").write_text(text + "id: 40\ndata: cut\n\n")
    (tmp_path / "more").write_text(sse("put", "y", 41))
    assert run() == [*((k, f"x{k}") for k in range(40)), (40, "cut"), (41, "y")]
    assert run()[-1] == (41, "y") and len(run()) == 42


def test_a_stream_can_be_stopped_and_goes_on(spark, tmp_path):
    (tmp_path / "log").write_text("".join(sse("put", f"x{k}", k) for k in range(60)))
    scratch, stop = Scratch(spark), threading.Event()
    stream = lambda: events.events(spark, str(tmp_path), max_bytes=60).select("id")
    query = stream().writeStream.foreachBatch(lambda rows, batch: stop.set() if batch == 1 else None).option("checkpointLocation", scratch.path("p")).start()
    updates.drain(query, stop, every=0.05)
    done = query.lastProgress["batchId"]
    assert stop.is_set() and not query.isActive and done < 19
    seen = []
    again = stream().writeStream.foreachBatch(lambda rows, batch: seen.append(batch)).option("checkpointLocation", scratch.path("p")).start()
    updates.drain(again)
    assert seen[0] in (done, done + 1) and seen[-1] >= 19


def test_errors_of_a_batch_are_raised(spark, tmp_path):
    (tmp_path / "log").write_text(sse("put", "x"))

    def fail(rows, batch):
        raise ValueError("this batch")

    query = events.events(spark, str(tmp_path)).writeStream.foreachBatch(fail).option("checkpointLocation", Scratch(spark).path("p")).start()
    with pytest.raises(Exception, match="this batch"):
        updates.drain(query)


KEYED = StructType([StructField("id", LongType()), StructField("value", StringType())])


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    scratch = Scratch(spark)
    table = Snapshot(scratch, "t", KEYED, ["id"], buckets=16)
    assert len(table.apply(spark.range(500).selectExpr("id", "'a' AS value"), 0)) == 16
    touched = table.apply(spark.createDataFrame([(7, "b"), (9000, "c")], KEYED), 1)
    assert 1 <= len(touched) <= 2
    written = spark.read.parquet(scratch.path("t/batch=1")).select(F.input_file_name()).distinct().count()
    assert written == len(touched) and table.apply(spark.createDataFrame([], KEYED), 2) == []
    got = {r["id"]: r["value"] for r in table.read().collect()}
    assert got == {k: "a" for k in range(500)} | {7: "b", 9000: "c"}
    # A batch of which nothing says that it is whole is not seen; replayed, it is made from the same versions.
    table.apply(spark.createDataFrame([(7, "d")], KEYED), 3)
    scratch.drop("t/batch=3/_SUCCESS")
    assert {r["id"]: r["value"] for r in table.read().collect()}[7] == "b"
    for _ in range(2):
        table.apply(spark.createDataFrame([(7, "d")], KEYED), 3)
        assert {r["id"]: r["value"] for r in table.read().collect()} == got | {7: "d"}
    for batch in range(4, 8):
        table.apply(spark.createDataFrame([(7, f"e{batch}")], KEYED), batch)
    assert max(len(v) for v in table.versions().values()) == 2 and table.read().count() == 501


class Service(BaseHTTPRequestHandler):
    ANSWERS = {1: (200, '{"id": 1}'), 2: (200, "null"), 3: (503, "busy"), 4: (200, "[1]"), 5: (204, "null"), 6: (200, "{oops")}

    def do_GET(self):
        status, body = self.ANSWERS[int(self.path.removeprefix("/v0/item/").removesuffix(".json"))]
        self.send_response(status)
        self.end_headers()
        if status != 204:
            self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_items_of_a_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = item_source.items_between(spark, 1, 6, url=f"http://127.0.0.1:{server.server_port}/v0", ids_per_task=2).collect()
    server.shutdown()
    server.server_close()
    got = {r["id"]: (r["status"], r["http_status"], (r["error"] or "").split(":")[0]) for r in rows}
    assert got == {1: ("found", 200, ""), 2: ("missing", 200, ""), 3: ("error", 503, "http"), 4: ("error", 200, "decode"), 5: ("error", 204, "decode"), 6: ("error", 200, "decode")}
    silent = item_source.items_between(spark, 1, 1, url=f"http://127.0.0.1:{server.server_port}", timeout=1).collect()[0]
    assert silent["status"] == "error" and silent["http_status"] is None and silent["error"].startswith("network")


def test_items_of_shards(spark, tmp_path):
    rows = [(1, '{"id": 1,\n "a":\t"\\t"}'), (2, "null"), (3, None), (25, '{"id": 25}'), (31, "nope")]
    item_source.store(spark.createDataFrame(rows, "id long, payload string"), str(tmp_path / "s"), width=10)
    options = {"path": str(tmp_path / "s"), "width": 10}
    expected = {1: "found", 2: "missing", 3: "missing", 4: "missing", 25: "found", 31: "error", 99: "missing"}
    got = {r["id"]: r["status"] for r in item_source.items_between(spark, 0, 99, ids_per_task=7, **options).collect()}
    assert len(got) == 100 and {k: got[k] for k in expected} == expected
    ids = spark.createDataFrame([(k,) for k in expected], "id long")
    assert {r["id"]: r["status"] for r in item_source.items_of(ids, **options).collect()} == expected


def test_items_that_a_stream_names(spark, tmp_path):
    """Errors stop a strict run, which goes on once they are mended; a lenient one counts them. Each named id counts once."""
    (tmp_path / "log").write_text("".join(sse("put", '{"path": "/", "data": {"items": [%d, %d]}}' % (k, k + 1), k) for k in range(1, 9)) + sse("keep-alive", "null"))
    answers = {5: "error", 6: "missing"}

    def fetch(ids):
        status = F.coalesce(*(F.when(F.col("id") == k, v) for k, v in answers.items()), F.lit("found"))
        return ids.select("id", F.lit("v").alias("value"), status.alias("status"))

    def run(scratch, **options):
        ids = updates.changed_ids(events.events(spark, str(tmp_path), max_bytes=150), "data").select("item_id")
        table = Snapshot(scratch, "kept", KEYED, ["id"], buckets=4)
        updates.follow_items(ids, fetch, table, **options)
        return sorted(r["id"] for r in table.read().collect())

    counters = Counters()
    assert run(Scratch(spark), counters=counters, strict=False) == [1, 2, 3, 4, 7, 8, 9]
    assert counters.totals() == {"batch_size": 2, "named": 16, "records_pulled": 14, "records_failed": 2} | {"batch_size": counters.totals()["batch_size"]}
    assert counters.totals()["batch_size"] in (2, 4)
    scratch = Scratch(spark)
    with pytest.raises(Exception, match="could not be fetched"):
        run(scratch)
    answers[5] = "found"
    assert run(scratch) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_ids_are_fetched_in_as_many_tasks_as_shuffles_have(spark, tmp_path):
    """Few bytes of ids are much work: sizes must not merge their tasks."""
    item_source.store(spark.range(0, 400).selectExpr("id", "concat('{\"id\":', id, '}') AS payload"), str(tmp_path), 10)
    got = item_source.items_of(spark.range(0, 400), path=str(tmp_path), width=10)
    got.write.parquet(str(tmp_path / "got"))
    files = spark.read.parquet(str(tmp_path / "got")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in files) == 400
