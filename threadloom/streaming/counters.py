"""Counters of a running stream, taken from what the stream itself observes."""

from __future__ import annotations

import threading

from pyspark.sql.streaming import StreamingQueryListener


class Counters(StreamingQueryListener):
    """batch_size (of the last batch with any id), named, records_pulled and records_failed of a stream that names ids. Each named id counts once: a batch that is replayed replaces its counts."""

    NAME = "named"

    def __init__(self) -> None:
        self.sizes: dict[int, int] = {}
        self.fetched: dict[int, tuple[int, int]] = {}
        self.ended = threading.Event()

    def add(self, batch: int, pulled: int, failed: int) -> None:
        self.fetched[batch] = (pulled, failed)

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.NAME)
        if seen is not None and event.progress.numInputRows:
            self.sizes[event.progress.batchId] = seen["size"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def totals(self) -> dict[str, int]:
        filled = [batch for batch, n in self.sizes.items() if n]
        return {
            "batch_size": self.sizes[max(filled)] if filled else 0,
            "named": sum(self.sizes.values()),
            "records_pulled": sum(p for p, _ in self.fetched.values()),
            "records_failed": sum(f for _, f in self.fetched.values()),
        }
