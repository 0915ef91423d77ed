"""Operator 13: alignment of two tokenizers' tokens, by distinct segments.

Texts are cut before each run of white space that begins with a space and follows anything else. No entry of either vocabulary has a space after
anything but white space (``tokens.cuts_are_safe`` verifies it on the files), so no token of either crosses a cut, and a text's tokens are
those of its segments. Each distinct segment is tokenised and aligned once, wherever it occurs; alignments are joined back and documents composed of them.

A group ends where tokens of both end. Its A tokens and B tokens are linked, all with all. A pair's count is the number of documents that hold it linked.

Scale: documents are gathered into blocks of about ``BLOCK_CHARS`` as they are read. A block is written as its documents, lists of numbers, and its
distinct segments. Segments meet by one shuffle on the segment, streamed in order, so the first of equals is tokenised and the others take its
alignment; a segment occurs once a block, so none is hot. Alignments return to their blocks, packed, where numpy composes the documents. Each leaves its digest and its
linked pairs with their links; the block leaves the number of its documents for each pair. Those are summed, and come back by (block, pair) to be multiplied
with the documents' links. A task holds one block, or one document if that is longer; of its alignments only what each document needs is kept, worked out for a stretch of segments at a time.

Defined cases: null and empty texts, and texts whose joined token bytes are not the space and the text (the piece vocabulary writes spaces as U+2581, so
such a character is lost), have no tokens, zeros and an empty string; rows that share a doc_id, or have none, are each a document; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import tokens
from threadloom.llm.common import Scratch, documents

BLOCK_CHARS = 12_000_000
CHUNK_NUMBERS, CHUNK_ALIGNMENTS = 200_000, 300_000
STRETCH_NUMBERS = 200_000  # of alignments that a block works out at a time
ENCODED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.binary())), ("nth", pa.int32()), ("segment", pa.string())])
ENCODED_DDL = "block long, doc_ids array<long>, numbers array<binary>, nth int, segment string"


def segments(text: str) -> list[str]:
    """Segments of space + text, each without the space that it begins with."""
    parts = text.split(" ")
    if all(p and not p[-1].isspace() for p in parts):
        return parts
    return [s[1:] for s in tokens.CUT.split(" " + text)]


def _pack(*arrays: np.ndarray) -> list[bytes]:
    """32-bit numbers, their lowest bytes first and their highest, which are mostly zeros, last; compressed."""
    return [zlib.compress(np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in arrays]


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of documents: rows (block, doc_ids, numbers) of some documents each, and (block, nth, segment) of the distinct segments."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        known: dict[str, int] = {}
        ids, lengths, numbers = [], [], []
        none = lambda n, k: pa.nulls(n, ENCODED.field(k).type)

        def chunk() -> pa.RecordBatch:
            row = [pa.array([(task << 32) + made]), pa.array([ids], ENCODED.field(1).type), pa.array([_pack(np.array(lengths), np.array(numbers))], ENCODED.field(2).type)]
            return pa.RecordBatch.from_arrays([*row, none(1, 3), none(1, 4)], schema=ENCODED)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made] * n), none(n, 1), none(n, 2), pa.array(range(at, at + n), pa.int32()), pa.array(part)], schema=ENCODED)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [known.setdefault(s, len(known)) for s in segments(text)] if text else []
                ids.append(doc_id)
                lengths.append(len(own))
                numbers += own
                size += len(text or "")
                if len(numbers) >= CHUNK_NUMBERS or len(ids) >= CHUNK_NUMBERS or size >= BLOCK_CHARS:
                    yield chunk()
                    ids, lengths, numbers = [], [], []
                if size >= BLOCK_CHARS:
                    yield from dictionary()
                    made, size, known = made + 1, 0, {}
        if ids:
            yield chunk()
        yield from dictionary()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED_DDL)


class Aligner:
    """Alignments of segments as lists: for each group how many A and B tokens it has, and their ids; empty if bytes differ."""

    def __init__(self, byte_path: str, ranks_path: str, piece_path: str):
        if not tokens.cuts_are_safe(byte_path, piece_path):
            raise ValueError("a vocabulary has entries across the cuts")
        self.paths, self.encode = (byte_path, ranks_path), tokens.piece_bpe(piece_path).encode
        self.a_bytes, self.b_bytes = tokens.byte_bpe_bytes(byte_path), tokens.piece_bpe_bytes(piece_path)
        self.plain = tokens.byte_ranks(ranks_path).encode_ordinary

    def byte_ids(self, text: str) -> list[int]:
        if len(text) < 1000 and not tokens.UNSETTLED.search(text):
            return self.plain(text)
        return tokens.byte_ids(text, *self.paths, special_as_text=True).tolist()

    def piece_ids(self, segment: str) -> list[int]:
        """The library puts the space in front itself, but not before nothing."""
        if segment:
            return self.encode(segment)
        return self.encode("a ")[len(self.encode("a")) :]

    def align(self, segment: str) -> list[int]:
        text = " " + segment
        a, b, whole = self.byte_ids(text), self.piece_ids(segment), text.encode()
        a_parts, b_parts = [self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b]
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            return []
        out: list[int] = []
        i = j = 0
        while i < len(a):
            i0, j0, i_end, j_end = i, j, len(a_parts[i]), len(b_parts[j])
            i, j = i + 1, j + 1
            while i_end != j_end:
                if i_end < j_end:
                    i_end, i = i_end + len(a_parts[i]), i + 1
                else:
                    j_end, j = j_end + len(b_parts[j]), j + 1
            out += (i - i0, j - j0, *a[i0:i], *b[j0:j])
        return out


def alignments(dictionary: DataFrame, byte_path: str, ranks_path: str, piece_path: str) -> DataFrame:
    """(block, packed) of (block, nth, segment): numbers of segments, lengths and contents of their alignments. Equal segments follow one another, and the first is aligned for all."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, last, made = Aligner(byte_path, ranks_path, piece_path), None, []
        held: dict[int, tuple[list[int], list[int], list[int]]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, arrays in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pack(*map(np.array, arrays))], pa.list_(pa.binary()))], names=["block", "packed"])

        for batch in batches:
            for block, nth, segment in zip(*(batch.column(c).to_pylist() for c in ("block", "nth", "segment")), strict=True):
                if segment != last:
                    last, made = segment, aligner.align(segment)
                numbers, lengths, contents = held.setdefault(block, ([], [], []))
                numbers.append(nth)
                lengths.append(len(made))
                contents += made
                count += 1 + len(made) // 16
            if count >= CHUNK_ALIGNMENTS:
                yield from flush()
                held, count = {}, 0
        yield from flush()

    ordered = dictionary.select("block", "nth", "segment").repartition("segment").sortWithinPartitions("segment")
    return ordered.mapInArrow(align, "block long, packed array<binary>")


class Block:
    """The alignments of a block's segments by number: tokens, groups and links, groups as text, and the pairs of segment k, with their links, at starts[k]:starts[k + 1].

    Worked out for a stretch of segments at a time, so that only what is kept grows with the block.
    """

    def __init__(self, packed: list[list[bytes]]):
        parts = [[_unpack(x) for x in row] for row in packed]
        numbers, lengths, contents = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.uint32) for i in range(3))
        del parts
        begin, length = np.zeros((2, len(numbers)), dtype=np.int64)
        begin[numbers], length[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
        self.ok = length > 0
        made = [self._stretch(contents, begin[low:high], length[low:high]) for low, high in _stretches(length)]
        sizes, said, n_pairs, times, pairs, ranks = zip(*made, strict=True) if made else [[]] * 6
        self.sizes = np.concatenate([np.zeros((0, 4), dtype=np.int64), *sizes])
        self.said = pa.concat_arrays([pa.array([], pa.large_binary()), *said])
        self.n_pairs, self.times = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (n_pairs, times))
        self.starts = np.cumsum(self.n_pairs) - self.n_pairs
        self.pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))
        self.ranks = np.concatenate([np.zeros(0, dtype=np.int32), *(np.searchsorted(self.pairs, x).astype(np.int32)[y] for x, y in zip(pairs, ranks, strict=True))])

    def _stretch(self, contents: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple:
        """(sizes, groups as text, numbers of pairs, links of each, distinct pairs, which of them each is) of consecutive segments."""
        count, starts = len(length), np.cumsum(length) - length
        contents = contents[np.repeat(begin - starts, length) + np.arange(length.sum())].astype(np.int64)

        # The first groups of all segments, then the second ones, and so on.
        segment = np.flatnonzero(length)
        head, found = starts[segment], []
        while len(segment):
            found.append((segment, head, contents[head], contents[head + 1]))
            head = head + 2 + found[-1][2] + found[-1][3]
            more = head < starts[segment] + length[segment]
            segment, head = segment[more], head[more]
        segment, head, k, m = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.int64)] * 4
        sums = [np.bincount(segment, weights=x, minlength=count) for x in (k, m, np.ones(len(k)), k * m)]
        return np.stack(sums, axis=1).astype(np.int64), _said(contents, starts, head, k, m), *_links(contents, segment, head, k, m, count)

    def linked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the distinct pairs, links of each) of a document's segments."""
        lengths = self.n_pairs[numbers]
        at = np.repeat(self.starts[numbers] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        distinct, which = np.unique(self.ranks[at], return_inverse=True)
        return distinct, np.bincount(which, weights=self.times[at]).astype(np.int64)

    def digest(self, numbers: np.ndarray) -> str:
        """Of a document's groups as text; what each segment ends with is between it and the next, but goes after the last."""
        own = self.said.take(pa.array(numbers))
        end = int(np.frombuffer(own.buffers()[1], dtype=np.int64)[len(own)])
        return hashlib.sha256(own.buffers()[2][: end - 1]).hexdigest()


def _stretches(length: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of segments with about STRETCH_NUMBERS numbers, or one longer segment."""
    at = np.cumsum(length + 1) // STRETCH_NUMBERS
    edges = [0, *(1 + np.flatnonzero(np.diff(at))).tolist(), len(length)]
    return [(low, high) for low, high in zip(edges[:-1], edges[1:], strict=True) if high > low]


def _said(contents: np.ndarray, starts: np.ndarray, head: np.ndarray, k: np.ndarray, m: np.ndarray) -> pa.LargeBinaryArray:
    """Groups of each segment as text, each with a semicolon after it."""
    after, is_id = np.zeros(len(contents), dtype=np.int8), np.ones(len(contents), dtype=bool)
    after[head + 1 + k], after[head + 1 + k + m] = 1, 2
    is_id[head] = is_id[head + 1] = False
    marks = pa.DictionaryArray.from_arrays(pa.array(after[is_id]), pa.array([",", "|", ";"])).dictionary_decode()
    written = pc.binary_join_element_wise(pa.array(contents[is_id]).cast(pa.string()), marks, "")
    ids = np.concatenate([[0], np.cumsum(is_id)])[np.append(starts, len(contents))]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ids), written.cast(pa.large_binary())), pa.scalar(b"", pa.large_binary()))


def _links(contents: np.ndarray, segment: np.ndarray, head: np.ndarray, k: np.ndarray, m: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of pairs of each segment, links of each pair, distinct pairs, which of them each is)."""
    small = k * m <= 4096
    links = (k * m)[small]
    group = np.repeat(np.flatnonzero(small), links)
    nth = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    a = contents[head[group] + 2 + nth // m[group]]
    b = contents[head[group] + 2 + k[group] + nth % m[group]]
    of, pairs, times = [segment[group]], [a << 16 | b], [np.ones(len(a), dtype=np.int64)]
    for g in np.flatnonzero(~small):  # distinct ids alone, however often they repeat
        a, n_a = np.unique(contents[head[g] + 2 : head[g] + 2 + k[g]], return_counts=True)
        b, n_b = np.unique(contents[head[g] + 2 + k[g] : head[g] + 2 + k[g] + m[g]], return_counts=True)
        pairs.append((a[:, None] << 16 | b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        of.append(np.full(len(pairs[-1]), segment[g]))
    of, pairs, times = map(np.concatenate, (of, pairs, times))
    order = np.argsort(of, kind="stable")
    distinct, which = np.unique(pairs[order], return_inverse=True)
    return np.bincount(of, minlength=count), times[order], distinct, which.astype(np.int32)


COMPOSED_DDL = "block long, doc_ids array<long>, sizes array<binary>, digests array<string>, links array<binary>, pair long, n long"
COMPOSED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.binary())), ("digests", pa.list_(pa.string())), ("links", pa.list_(pa.binary())), ("pair", pa.int64()), ("n", pa.int64())])


def compose_block(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Rows of documents (their sizes, digests, and linked pairs as ranks among the block's), and (pair, n) in the order of ranks: how many documents hold each."""
    block = Block(found.column("packed").to_pylist())
    counts = np.zeros(len(block.pairs), dtype=np.int64)
    rows = []
    for name, ids, packed in zip(*(docs.column(c).to_pylist() for c in ("block", "doc_ids", "numbers")), strict=True):
        lengths, numbers = map(_unpack, packed)
        ends = np.cumsum(lengths, dtype=np.int64)
        sizes, digests, distinct, links = [], [], [], []
        for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
            own = numbers[end - length : end]
            whole = length > 0 and bool(block.ok[own].all())
            own = own if whole else own[:0]
            pairs, n = block.linked(own)
            counts[pairs] += 1
            sizes.append(block.sizes[own].sum(axis=0))
            digests.append(block.digest(own) if whole else "")
            distinct.append(np.diff(pairs, prepend=0))
            links.append(n)
        wide = np.array(sizes, dtype=np.int64)
        halves = _pack(wide & 0xFFFFFFFF, wide >> 32)
        n_pairs = np.array([len(x) for x in distinct])
        rows.append((name, ids, halves, digests, _pack(n_pairs, np.concatenate(distinct), np.concatenate(links)), None, None))
    name = rows[0][0] if rows else None
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, COMPOSED, strict=True)]
    n = len(counts)
    held = [pa.array([name] * n, pa.int64()), *(pa.nulls(n, COMPOSED.field(k).type) for k in range(1, 5)), pa.array(block.pairs, pa.int64()), pa.array(counts, pa.int64())]
    return pa.concat_tables([pa.Table.from_arrays(columns, schema=COMPOSED), pa.Table.from_arrays(held, schema=COMPOSED)])


RESULT = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def weigh_block(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """The results of a block's documents, from the counts of its pairs."""
    order = np.argsort(counted.column("pair").to_numpy())
    weight = np.stack([counted.column(c).to_numpy()[order].astype(np.int64) for c in ("best", "n")], axis=1) if len(order) else np.zeros((0, 2), dtype=np.int64)
    out = []
    for ids, halves, digests, packed in zip(*(docs.column(c).to_pylist() for c in ("doc_ids", "sizes", "digests", "links")), strict=True):
        low, high = (_unpack(x).astype(np.int64) for x in halves)
        n_pairs, steps, links = (_unpack(x).astype(np.int64) for x in packed)
        ends = np.cumsum(n_pairs)
        # Ranks begin anew with each document: take away what the steps before it add up to.
        total = np.concatenate([[0], np.cumsum(steps)])
        ranks = total[1:] - np.repeat(total[ends - n_pairs], n_pairs)
        sums = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(weight[ranks] * links[:, None], axis=0)])
        values = np.concatenate([(low | high << 32).reshape(-1, 4), sums[ends] - sums[ends - n_pairs]], axis=1)
        out.append(pa.Table.from_arrays([pa.array(ids, pa.int64()), *(pa.array(values[:, k]) for k in range(6)), pa.array(digests, pa.string())], schema=RESULT))
    return pa.concat_tables(out) if out else RESULT.empty_table()


def align_documents(docs: DataFrame, byte_path: str | None = None, ranks_path: str | None = None, piece_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, pairs): a row per document, and each linked pair (a, b, n, best) with its number of documents and whether that is its a's highest."""
    scratch = Scratch(docs.sparkSession)
    given = zip((byte_path, ranks_path, piece_path), (tokens.BYTE_BPE, tokens.BYTE_BPE_RANKS, tokens.PIECE_BPE), strict=True)
    paths = [path or public_tokenizers.path(name) for path, name in given]
    made = scratch.table("encoded", encoded(docs))
    found = scratch.table("alignments", alignments(made.filter("nth IS NOT NULL"), *paths))
    texts = made.filter("nth IS NULL").select("block", "doc_ids", "numbers")
    composed = scratch.table("composed", texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(compose_block, COMPOSED_DDL))
    scratch.drop("encoded", "alignments")

    held = composed.filter("pair IS NOT NULL").select("block", "pair", "n")
    a = F.shiftright("pair", 16)
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    counts = scratch.table("counts", counts.withColumn("a", a).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    rows = composed.filter("pair IS NULL").select("block", "doc_ids", "sizes", "digests", "links")
    wanted = held.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    result = rows.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(weigh_block, RESULT_DDL)
    pairs = counts.filter("n > 0").select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "n", "best")
    return result, pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir))[0]
