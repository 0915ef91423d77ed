"""Items by id: found, missing, or an error, from an item service or from shards of stored payloads.

``spark.read.format("item_source")`` with ``start`` and ``end`` gives one row for each id between them, read in tasks of ``ids_per_task``. With ``url`` a task asks
``{url}/item/{id}.json`` for each id; with ``path`` it reads the shards of its ids. Rows are (id, status, payload, http_status, error): found with the payload;
missing, for a 2xx answer of ``null`` and for an id that no shard holds; error with its text, and the HTTP status if there was an answer.

A folder of shards holds ``shard=K`` for the ids from K * width on, each a folder of lines ``id<TAB>payload``. Files are opened by pyarrow, from any store it knows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from urllib.error import HTTPError
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadloom.sources.events import opened, recorded

SCHEMA = "id long, status string, payload string, http_status int, error string"
ROW = pa.schema([("id", pa.int64()), ("status", pa.string()), ("payload", pa.string()), ("http_status", pa.int32()), ("error", pa.string())])
Answer = tuple[str, str | None, int | None, str | None]


def answered(payload: str, http_status: int | None = None) -> Answer:
    """What a payload says: null is a missing item; anything but one JSON object is an error."""
    try:
        value = json.loads(payload)
    except (ValueError, RecursionError) as error:
        return "error", payload, http_status, f"decode: {error}"
    if value is None:
        return "missing", None, http_status, None
    return ("found", payload, http_status, None) if isinstance(value, dict) else ("error", payload, http_status, "decode: not an object")


def ask(url: str, item: int, seconds: float) -> Answer:
    """The answer of an item service. Answers other than 2xx, and none at all, are errors."""
    try:
        with urlopen(f"{url.rstrip('/')}/item/{item}.json", timeout=seconds) as reply:  # noqa: S310
            return answered(reply.read().decode("utf-8", "replace"), reply.status)
    except HTTPError as error:
        return "error", None, error.code, f"http: {error.reason}"
    except OSError as error:
        return "error", None, None, f"network: {error}"


def from_service(url: str, seconds: float, ids: Sequence[int]) -> Iterator[tuple]:
    for item in ids:
        yield (item, *ask(url, item, seconds))


def from_shards(path: str, width: int, ids: Sequence[int]) -> Iterator[tuple]:
    """Ids in order; of lines with the same id the last one read counts, files being read by name. One shard is held at a time, and of it only what is asked for."""
    files, at = opened(path)[0], 0
    while at < len(ids):
        shard = ids[at] // width
        own = []
        while at < len(ids) and ids[at] // width == shard:
            own.append(ids[at])
            at += 1
        wanted, held = set(own), {}
        for info in recorded(f"{path}/shard={shard}"):
            with files.open_input_stream(info.path) as file:
                for line in io.BufferedReader(file):
                    number, _, payload = line.partition(b"\t")
                    if int(number) in wanted:
                        held[int(number)] = payload.decode("utf-8", "replace").rstrip("\n")
        for item in own:
            yield (item, *(answered(held[item]) if item in held else ("missing", None, None, None)))


def reader(options: dict[str, str]) -> Callable[[Sequence[int]], Iterator[tuple]]:
    if "url" in options:
        return partial(from_service, options["url"], float(options.get("timeout", 30)))
    return partial(from_shards, options["path"], int(options["width"]))


@dataclass
class Ids(InputPartition):
    start: int
    end: int


class ItemReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.fetch, self.start, self.end = reader(options), int(options["start"]), int(options["end"])
        self.per_task = int(options.get("ids_per_task", 10_000))

    def partitions(self) -> Sequence[InputPartition]:
        return [Ids(at, min(at + self.per_task - 1, self.end)) for at in range(self.start, self.end + 1, self.per_task)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.fetch(range(partition.start, partition.end + 1))


class ItemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "item_source"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ItemReader:
        return ItemReader(dict(self.options))


def items_between(spark: SparkSession, start: int, end: int, **options) -> DataFrame:
    """A row for each id from start to end. Options: url and timeout, or path and width; ids_per_task."""
    spark.dataSource.register(ItemSource)
    return spark.read.format("item_source").options(start=start, end=end, **options).load()


def items_of(ids: DataFrame, ids_per_shard: int = 10_000, **options) -> DataFrame:
    """The same for a table of distinct ids, those of a shard's width in one task. As many tasks as shuffles have: ids are few bytes, whose fetch is the work, so sizes must not merge them."""
    fetch = reader({k: str(v) for k, v in options.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(fetch(batch.column("id").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ROW)], schema=ROW)

    width = int(options.get("width", ids_per_shard))
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = ids.select(F.col("id").cast("long").alias("id"), F.floor(F.col("id") / width).alias("shard")).repartition(tasks, "shard").sortWithinPartitions("id")
    return near.select("id").mapInArrow(read, SCHEMA)


def store(payloads: DataFrame, path: str, width: int = 10_000) -> None:
    """Writes (id, payload) as shards. Line ends in a payload, which JSON allows only between tokens, become spaces."""
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), F.translate(F.coalesce("payload", F.lit("null")), "\r\n", "  "))
    rows = payloads.select(line.alias("value"), F.floor(F.col("id") / width).cast("long").alias("shard"))
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)
