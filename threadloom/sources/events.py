"""The change stream as a source: folders of recorded server-sent events, followed as they grow.

``spark.readStream.format("event_stream").option("path", folder)`` reads every file below the folder, in the order of their names. The offset is a
place in the bytes of each file; a batch takes at most ``max_bytes`` in all, and ends after a whole event in every file. A file's new bytes are cut into tasks of
``task_bytes``. A task owns the events that begin in its range, so none is read twice and none is lost at a cut. Files are opened by pyarrow, from any store it knows.

Rows are (file, at, id, event, data): the name and first byte of where an event is recorded, its id if it has one, its type (message unless it says so), and its data lines
joined by newlines. Lines end in a newline alone; one or more empty lines end an event. Comments, and events without data, give no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, id string, event string, data string"
END = b"\n\n"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def recorded(path: str) -> list[pyarrow.fs.FileInfo]:
    """The folder's files of events by name; hidden files and marks of completed jobs are none."""
    files, root = opened(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return sorted((x for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)


def recorded_bytes(path: str) -> int:
    return sum(info.size for info in recorded(path))


@dataclass
class Span(InputPartition):
    path: str
    file: str
    start: int
    end: int


def parse(block: bytes) -> tuple[str | None, str, str] | None:
    """(id, type, data) of an event's lines; None for one without data. Other fields are not kept."""
    number, kind, data = None, "message", []
    for line in block.decode("utf-8", "replace").split("\n"):
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "event":
            kind = value
        elif field == "id":
            number = value
        elif field == "data":
            data.append(value)
    return (number, kind, "\n".join(data)) if data else None


def read_span(span: Span, step: int = 1 << 20) -> Iterator[tuple]:
    """The events that begin in a span: at 0, or after empty lines. The last one may end beyond the span."""
    files, path = opened(span.path)
    with files.open_input_file(f"{path}/{span.file}") as file:
        at = max(span.start - len(END), 0)
        file.seek(at)
        held = b""

        def block() -> bytes | None:
            """Bytes up to the next empty line, taken from what is held; None if there is no such line."""
            nonlocal at, held
            while (cut := held.find(END)) < 0:
                new = file.read(step)
                if not new:
                    return None
                held += new
            made, at, held = held[:cut], at + cut + len(END), held[cut + len(END) :]
            return made

        def skip_newlines() -> None:
            nonlocal at, held
            while True:
                rest = held.lstrip(b"\n")
                at, held = at + len(held) - len(rest), rest
                if held or not (held := file.read(step)):
                    return

        if span.start > 0 and block() is None:  # the rest of an event that began before
            return
        skip_newlines()
        while at < span.end:
            began = at
            made = block()
            if made is None:
                return
            row = parse(made)
            if row:
                yield (span.file, began, *row)
            skip_newlines()


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.max_bytes, self.task_bytes = int(options.get("max_bytes", 1 << 28)), int(options.get("task_bytes", 1 << 24))
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What has been read and the next events, file by file, within the bound. Only an event that is longer than the bound by itself exceeds it."""
        files, left, offset = opened(self.path)[0], self.max_bytes, dict(self.reached)
        for info in recorded(self.path):
            start = offset.get(info.base_name, 0)
            if info.size > start and left > 0:
                end = self._last_end(files, info.path, start, min(info.size, start + left), info.size if left == self.max_bytes else 0)
                if end > start:
                    offset[info.base_name] = end
                    left -= end - start
        return offset

    @staticmethod
    def _last_end(files: pyarrow.fs.FileSystem, path: str, start: int, end: int, size: int, step: int = 1 << 16) -> int:
        """The end of the last whole event that ends by ``end``; of the first one if that ends later; start if there is none."""
        with files.open_input_file(path) as file:
            high = end
            while high > start:
                low = max(start, high - step)
                file.seek(low)
                cut = file.read(min(high + 1, end) - low).rfind(END)
                if cut >= 0:
                    return low + cut + len(END)
                high = low
            low, tail = end, b""
            while low < size:
                file.seek(low)
                new = file.read(step)
                cut = (tail + new).find(END)
                if cut >= 0:
                    return low - len(tail) + cut + len(END)
                low, tail = low + len(new), (tail + new)[-1:]
        return start

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.reached = dict(end)  # also after a restart, when Spark tells the source where it was
        spans = []
        for file, stop in end.items():
            for at in range(start.get(file, 0), stop, self.task_bytes):
                spans.append(Span(self.path, file, at, min(at + self.task_bytes, stop)))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition)


class EventStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EventReader:
        return EventReader(dict(self.options))


def events(spark: SparkSession, path: str, max_bytes: int = 1 << 28, task_bytes: int = 1 << 24) -> DataFrame:
    """The stream of a folder's events."""
    spark.dataSource.register(EventStream)
    return spark.readStream.format("event_stream").option("path", path).option("max_bytes", max_bytes).option("task_bytes", task_bytes).load()


def record(messages: DataFrame, path: str) -> None:
    """Writes rows (id, event, data) as recorded events, a file a task. Null data is a comment, as a quiet server sends."""
    lines = F.concat(F.lit("data: "), F.replace(F.col("data"), F.lit("\n"), F.lit("\ndata: ")), F.lit("\n"))
    head = F.concat(F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\n")), F.lit("")), F.lit("event: "), F.col("event"), F.lit("\n"))
    messages.select(F.coalesce(F.concat(head, lines), F.lit(": quiet\n"))).write.mode("append").text(path)
