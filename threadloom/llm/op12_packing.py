"""Operator 12: best-fit packing of documents into sequences, in bulk-synchronous steps.

A document is its token ids and an end token. Documents longer than a sequence are cut into whole sequences from the end, the first piece taking the rest. Pieces are range-sorted by
length, longest first, and ranked. Pieces of one length are interchangeable, and so are gaps (open sequences) of one size, so a step treats a whole run of
pieces at once: it sweeps to the successor of its length among the gap sizes, which is the best fit, and puts as many pieces into each gap of that size as
fit; which piece meets which gap is a matter of rank alone (the k-th gap takes the k-th batch of the run), so no two want the same place. Gaps are updated, and the
run's rest repeats the sweep; without a successor new sequences open. That is best-fit decreasing, piece for piece.

Scale: the documents are tokenised, range-sorted, counted and placed in parallel, and go nowhere as a whole. The steps need only the counts of the
at most 2048 lengths, so they run on the driver. Each move at least halves the gaps that it fills, and a run leaves at most two split ranges of sequences behind, so
there are fewer than 3 * 2048 * 12 moves, however many documents; they travel to the tasks, which find a piece's move by its rank. A length that a third of
all pieces share (empty documents) is spread over tasks by the sort, whose last key is unique. A long text is tokenised in parts cut where no token can cross.

Defined cases: null and empty texts are the end token alone; rows that share a doc_id, or have none, are each a document; an empty table gives an empty result; the
strings of special tokens in a text become their ids, as the tokenizer's default is; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import tokens
from threadloom.llm.common import Scratch, arrow_rows, documents

SIZE, END = 2048, 0
PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pieces(docs: DataFrame, size: int = SIZE, with_ids: bool = False, byte_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32, ids): each document's pieces; ``row`` numbers documents, ids are null unless asked for."""
    byte_path, ranks_path = byte_path or public_tokenizers.path(tokens.BYTE_BPE), ranks_path or public_tokenizers.path(tokens.BYTE_BPE_RANKS)

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.append(tokens.byte_ids(text or "", byte_path, ranks_path), END).astype("<u4")
            start, stop = 0, (len(ids) - 1) % size + 1
            for piece in range((len(ids) - 1) // size + 1):
                part = ids[start:stop]
                yield row, doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None
                start, stop = stop, stop + size

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: arrow_rows(batches, cut, PIECES, 1000), "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def best_fit(runs: list[tuple[int, int]], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank over all runs, number of pieces, first sequence, pieces a sequence, offset) for runs (length, count), longest first."""
    moves, gaps, sizes = [], {}, []  # gaps: by size, ranges (first sequence, number) of open sequences
    opened = rank = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, number))

    for length, left in runs:
        while left:
            successor = bisect_left(sizes, length)
            if successor < len(sizes):
                gap = sizes[successor]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[successor]
            else:
                gap, first, number = size, opened, -(-left // (size // length))
                opened += number
            each = gap // length
            # Sequences that take all they can, then at most one that takes the run's rest.
            for filled, count in ((min(number, left // each), each), (1, left % each)):
                if filled and count and number and left:
                    filled = min(filled, number)
                    moves.append((length, rank, filled * count, first, count, size - gap))
                    leave(gap - count * length, first, filled)
                    rank, left, first, number = rank + filled * count, left - filled * count, first + filled, number - filled
                if left >= each:
                    break
            leave(gap, first, number)
    return moves


PLACED = pa.schema([*(PIECES.field(n) for n in ("row", "doc_id", "piece", "start", "length", "ids_crc32")), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    scratch = Scratch(cut.sparkSession)
    slim = scratch.table("pieces", cut.select("row", "doc_id", "piece", "start", "length", "ids_crc32"))
    order = (F.col("length").desc(), F.xxhash64("row", "piece"), F.col("row"))
    ranked = scratch.table("ranked", slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # Of each task of the sort and each length: tasks and lengths together, as both are in order.
    counted = ranked.groupBy(F.shiftright("at", 33).alias("task"), "length").agg(F.count(F.lit(1)).alias("n")).collect()
    runs, tasks = {}, {}
    for task, length, n in counted:
        runs[length] = runs.get(length, 0) + n
        tasks[task] = tasks.get(task, 0) + n
    before, offset_of = 0, np.zeros(max(tasks, default=0) + 1, dtype=np.int64)
    for task in sorted(tasks):
        offset_of[task] = before
        before += tasks[task]
    moves = np.array(best_fit(sorted(runs.items(), reverse=True), size), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            rank = offset_of[at >> 33] + (at & ((1 << 33) - 1))
            move = moves[np.searchsorted(moves[:, 1], rank, side="right") - 1]
            nth = rank - move[:, 1]
            sequence, offset = move[:, 3] + nth // move[:, 4], move[:, 5] + nth % move[:, 4] * move[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in PLACED.names[:6]), pa.array(sequence), pa.array(offset)], schema=PLACED)

    return ranked.mapInArrow(place, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, size: int = SIZE, **paths) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token sequences, and the document of each of their pieces. No group exceeds ``size`` tokens."""
    cut = Scratch(docs.sparkSession).table("tokens", pieces(docs, size, with_ids=True, **paths))
    joined = packed(cut, size).select("row", "piece", "doc_id", "sequence_id", "offset").join(cut.select("row", "piece", "ids"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(documents(spark, sf_dir))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
