"""Operator 7: language model scores from Brown class-based bigrams.

P(word | previous) = P(class | previous class) * P(word | class). Every training word has a class by the exchange algorithm, which
moves a word to the class that most raises the mutual information of adjacent classes. It is seeded on the ``CLUSTERED`` most
frequent words, one after another, in ``SWEEPS`` sweeps; then all words of the vocabulary choose in ``TURNS`` against the class table of
the turn before: the head words (the ``HEAD`` most frequent, equal counts in the order of the words) all at once, then the tail words, then each half of the head, then the
tail again. A half whose choices do not raise the information of adjacent classes is taken back before the next turn; the other turns stay as they fall. The table
counts every pair of adjacent words but those of two tail words.
The end of a text is a class of its own, also serving as the context of a first word. Each class keeps a count of one for words
that training lacks; such a word has the sum of these over all classes, and what follows it has class unigrams. Transitions count all
training tokens and are interpolated with class unigrams by a weight that leaving one out makes most likely; emissions have one added to each count, so
every text has a finite score.

Scale: word counts cover all training texts and are combined per batch before the shuffle. Pairs of head words stay where they are
counted; a turn adds them up per word and class, so what is shuffled is one short row per word and task. Each tail word's neighbours are gathered once, at most
2 * HEAD + 2 different ones for a word, so no task holds an unbounded group. The tail grows with the corpus and stays a table throughout; the
head is found by a histogram of counts and broadcast. The driver sees the head, its classes, class tables and the seed's table, (1024 + 2)^2.
In scoring, counts and classes of tail words are looked up in shuffled buckets of words.

Defined cases: null texts are empty and have the end token alone; with no training documents all counts are
0; a word with tail words alone beside it has the first class; equal rows of a doc_id get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, documents, held_out, text_rows, to_batch

HEAD, CLUSTERED, CLASSES, SWEEPS = 65_536, 1024, 48, 4
TURNS = ("head", "tail", "even", "odd", "tail")  # who chooses: all head words, half of them, or the tail words
FLUSH = 600_000  # words with counts that a task gathers before it adds them up, and hands them on if more than half are distinct
PAIRS = 2_000_000  # adjacent words that a task combines at a time
STRETCH = 5_000  # numbers in a packed row; Parquet holds 100 rows before it looks at their size
BUCKET = 400_000  # tail words' occurrences that a task gathers at a time, about
GROUP = 64  # head words whose counts travel together
CELLS = 20_000  # classes beside words that choose side by side
BATCH = "4m"  # of rows that pass between Spark and Python at a time, which both hold several times over; packed rows would fill Spark's own 64m
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH, and a row, for the tables written meanwhile."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def tokens(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Words of a batch's texts, one after another, and where those of each text begin and the last ends."""
    text = b.column(b.schema.get_field_index("text"))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    solid = pc.binary_length(words).to_numpy() > 0  # space at an end of a text leaves an empty word there
    return words.filter(pa.array(solid)).cast(pa.binary()), np.r_[0, np.cumsum(solid)][at - at[0]]


def listed(words: pa.Array) -> list[bytes]:
    """Words in Python, by one split of all, several times as fast as ``to_pylist``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().split()


def places(words: pa.Array, head: pa.Array) -> np.ndarray:
    """Place of each word in the head, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over whole texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            found = pc.value_counts(tokens(b)[0])
            held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "n"]))
            size += len(found)
            if size > FLUSH:
                held = [summed()]
                size = held[0].num_rows
                if size > FLUSH // 2:
                    yield from held[0].cast(schema).to_batches(50_000)
                    held, size = [], 0
        if size:
            yield from summed().cast(schema).to_batches(50_000)

    return text_rows(train).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_head(vocabulary: DataFrame, size: int) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """The ``size`` most frequent words, equal counts in the order of the words, their counts in descending order, and (word, n) of all others."""
    # Counts, of which there are far fewer than words, say where the head ends; the words of its last count are sorted apart.
    level = F.floor(F.log2("n") * 64).cast("int")
    above, cut = 0, None
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True):
        if above + r["count"] > size:
            cut = r["level"]
            break
        above += r["count"]
    if cut is None:
        head = vocabulary.toArrow()
    else:
        part = vocabulary.filter(level == cut).orderBy(F.col("n").desc(), "word").limit(size - above)
        head = vocabulary.filter(level > cut).unionByName(part).toArrow()
    head = head.sort_by([("n", "descending"), ("word", "ascending")])
    words, counts = [w.encode() for w in head.column("word").to_pylist()], head.column("n").to_numpy().astype(np.int64)
    if not words:
        return words, counts, vocabulary
    last = (F.col("n") == int(counts[-1])) & (F.col("word") > words[-1].decode())
    return words, counts, vocabulary.filter((F.col("n") < int(counts[-1])) | last)


PACKED = "bucket int, a binary, b binary, c binary"
_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def packed(bucket: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    return bucket, a.tobytes(), b.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()


def unpacked(row: dict, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["a"], kind), np.frombuffer(row["b"], np.int32), np.frombuffer(row["c"], np.int32)


def pair_counts(seq: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct first * width + second of adjacent places, none of them negative, and their counts; one array is made and sorted where it is."""
    pair = seq[:-1].astype(np.int64)
    pair *= width
    pair += seq[1:]
    pair = pair[(seq[:-1] >= 0) & (seq[1:] >= 0)]
    pair.sort()
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    return pair[first], np.diff(first, append=len(pair))


def word_pairs(train: DataFrame, head: list[bytes], buckets: int = 1) -> DataFrame:
    """Stretches of numbers: pairs of adjacent head words (bucket -1; first, second, count) and tail words (bucket of the hash; hash, what precedes, what follows).

    Words are their places in the head, the end is ``len(head)``, a tail word beside a tail word is -1; a tail word's hash is its xxhash64. Each text
    stands between two ends. Counts are a task's own, so a pair may be in many stretches.
    """
    shared, end = train.sparkSession.sparkContext.broadcast(pa.array(head, pa.binary())), len(head)

    def out(seq: np.ndarray, hashes: list[int]) -> Iterator[pa.RecordBatch]:
        pair, n = pair_counts(seq, end + 1)
        rows = [packed(-1, (x // (end + 1)).astype(np.int32), x % (end + 1), n[at : at + STRETCH]) for at in range(0, len(pair), STRETCH) for x in [pair[at : at + STRETCH]]]
        of, h = np.flatnonzero(seq < 0), np.array(hashes, np.uint64)
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        of, h, bucket = of[order], h[order].view(np.int64), bucket[order]
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows += [packed(int(bucket[low]), h[at : min(at + STRETCH, high)], seq[x - 1], seq[x + 1]) for at in range(low, high, STRETCH) for x in [of[at : min(at + STRETCH, high)]]]
        for at in range(0, len(rows), 50):
            yield to_batch(rows[at : at + 50], _PACKED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hashes, held = [np.array([end], np.int32)], [], 0
        for b in batches:
            words, at = tokens(b)
            ids = places(words, shared.value)
            hashes.extend(xxhash.xxh64_intdigest(w, 42) for w in listed(words.filter(pa.array(ids < 0))))
            parts.append(np.insert(ids, at[1:], end))
            held += len(parts[-1])
            if held > PAIRS:
                yield from out(np.concatenate(parts), hashes)
                parts, hashes, held = [np.array([end], np.int32)], [], 0
        if held:
            yield from out(np.concatenate(parts), hashes)

    return text_rows(train).mapInArrow(run, PACKED)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, clustered: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units below ``clustered`` by exchange, each other unit its own class after those."""
    n = len(bigrams)
    classes = max(1, min(classes, clustered))
    cls = np.r_[np.arange(clustered) % classes, classes + np.arange(n - clustered)]
    n_classes = classes + n - clustered
    bigrams = bigrams.astype(float)
    member = np.zeros((n, n_classes))
    member[np.arange(n), cls] = 1
    table, right, left = member.T @ bigrams @ member, bigrams @ member, bigrams.T @ member
    free = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            a, own = cls[w], bigrams[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            rows, cols = table[free], table[:, free].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + c) - _xlogx(cols)).sum(1)
            diagonal = table[free, free]
            gain -= _xlogx(diagonal + r[free]) + _xlogx(diagonal + c[free]) - 2 * _xlogx(diagonal)
            gain += _xlogx(diagonal + r[free] + c[free] + own) - _xlogx(diagonal)
            out, into = rows.sum(1), cols.sum(1)
            gain -= _xlogx(out + r.sum() + own) - _xlogx(out) + _xlogx(into + c.sum() + own) - _xlogx(into)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return cls


def best_classes(table: np.ndarray, cls: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """Class below ``classes`` of each word that most raises the mutual information, every other word staying where it is.

    ``right`` and ``left`` count the classes after and before each word, ``own`` the word beside itself. Exact, and linear in the
    number of classes that a word has beside it.
    """
    at, right, left = np.arange(len(cls)), right.copy(), left.copy()
    right[at, cls] -= own
    left[at, cls] -= own
    gain = np.zeros((len(cls), classes))
    inside = cls < classes
    for cells, mine, other in ((table, right, left), (table.T, left, right)):
        i, c = np.nonzero(mine)
        if not len(i):
            continue
        n, rows, a = mine[i, c], np.arange(len(i)), cls[i]
        base = cells[:classes, c].T.copy()  # what is left of the class pair once the word is taken out of its class
        stays, meets = inside[i], c == a
        base[rows[stays], a[stays]] -= n[stays]
        base[meets] -= other[i[meets], :classes]
        both = stays & meets
        base[rows[both], a[both]] -= own[i[both]]
        part = _xlogx(base + n[:, None]) - _xlogx(base)
        part[rows[c < classes], c[c < classes]] = 0  # the diagonal follows
        words, first = np.unique(i, return_index=True)
        gain[words] += np.add.reduceat(part, first, axis=0)
    for total, sign, add in (
        (np.diag(table), 1, right[:, :classes] + left[:, :classes] + own[:, None]),
        (table.sum(1), -1, (right.sum(1) + own)[:, None]),
        (table.sum(0), -1, (left.sum(1) + own)[:, None]),
    ):
        base = np.tile(total[:classes], (len(cls), 1))
        where = np.minimum(cls, classes - 1)
        base[at, where] -= np.where(inside, add[at, where] if add.shape[1] > 1 else add[:, 0], 0)
        gain += sign * (_xlogx(base + add) - _xlogx(base))
    best = gain.argmax(1)
    stay = inside & (gain[at, best] <= gain[at, np.minimum(cls, classes - 1)] + 1e-9)
    return np.where(stay, cls, best)


def information(table: np.ndarray) -> float:
    """Mutual information of adjacent classes, but for a factor and a constant that no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


STORED = 4000
CONTEXTS = "keys binary, cls binary, sizes binary, codes binary, ns binary"  # a stretch of words a row, so that few rows pass between Spark and Python
_CONTEXTS_SCHEMA = pa.schema([(c, pa.binary()) for c in ("keys", "cls", "sizes", "codes", "ns")])
_CONTEXT_SCHEMA = pa.schema([("key", pa.int64()), ("cls", pa.int32()), ("codes", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32()))])


def closed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Contexts of words as rows of ``CONTEXTS`` with about STORED entries."""
    codes, n = b.column("codes"), b.column("ns").flatten().to_numpy()
    keys, cls, sizes, flat = b.column("key").to_numpy(), b.column("cls").to_numpy(), np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy()
    ends = np.r_[0, np.cumsum(sizes)]
    cuts = np.r_[0, 1 + np.flatnonzero(np.diff((ends[1:] + np.arange(len(sizes))) // STORED)), len(sizes)].tolist()
    rows = [(*(x[low:high].tobytes() for x in (keys, cls, sizes)), *(x[ends[low] : ends[high]].tobytes() for x in (flat, n))) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    return to_batch(rows, _CONTEXTS_SCHEMA)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``CONTEXTS``, short ones together, as batches (key, cls, codes, ns)."""

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys, cls, sizes, codes, ns = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*held, strict=True))
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls), *(pa.ListArray.from_arrays(offsets, x) for x in (codes, ns))], schema=_CONTEXT_SCHEMA)

    held, size = [], 0
    for b in batches:
        for row in range(b.num_rows):
            held.append([np.frombuffer(b.column(i)[row].as_buffer(), np.int64 if i == 0 else np.int32) for i in range(5)])
            size += len(held[-1][3])
            if size > CELLS:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def classes_of(contexts: DataFrame) -> DataFrame:
    """(key, cls) of each word of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in opened(batches):
            yield b.select(["key", "cls"])

    return contexts.mapInArrow(run, "key long, cls int")


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], class_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row (key, cls, codes, ns) for each key of (keys, codes, counts), no key being in two parts; a code of -1 counts nothing."""

    def rows(keys: np.ndarray, codes: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        own, first = np.unique(keys, return_index=True)
        solid = codes >= 0
        offsets = np.r_[0, np.cumsum(solid)][np.r_[first, len(keys)]].astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, x[solid].astype(np.int32)) for x in (codes, ns)]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(class_of(own), pa.int32()), *lists], schema=_CONTEXT_SCHEMA)

    for keys, codes, ns in parts:
        order = np.lexsort((codes, keys))
        keys, codes, ns = keys[order], codes[order], ns[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])][: len(keys)])
        keys, codes, ns = keys[first], codes[first], np.add.reduceat(ns, first) if len(first) else ns
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        cuts = np.r_[edges[::5000], len(keys)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows(keys[low:high], codes[low:high], ns[low:high])


def tail_contexts(pairs: DataFrame, n_head: int, unclassed: int) -> DataFrame:
    """Contexts of each tail word: what follows it (codes are places in the head) and precedes it (n_head + 1 more).

    A task holds one bucket of words at a time, whose number follows the corpus.
    """
    width = n_head + 1

    def parts(batches: Iterator[pa.RecordBatch]):
        def merged(held):
            h, l, r = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: E741
            return np.r_[h, h], np.r_[r, np.where(l >= 0, l + width, -1)].astype(np.int32), np.ones(2 * len(h), np.int32)

        bucket, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if held and row["bucket"] != bucket:
                    yield merged(held)
                    held = []
                bucket = row["bucket"]
                held.append(unpacked(row, np.int64))
        if held:
            yield merged(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield from map(closed, gathered(iter([part]), lambda keys: np.full(len(keys), unclassed)))

    return pairs.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, CONTEXTS)


def head_contexts(pairs: DataFrame, tail: DataFrame, cls: np.ndarray, k: int) -> DataFrame:
    """Contexts of each head word: counts of classes after it (codes from 0), before it (from ``k``), and of itself beside it (2 * ``k``).

    ``cls`` holds the classes of the head and the end. Each task adds up its own counts; one short row per GROUP words travels.
    """
    n_head, width, shared = len(cls) - 1, 2 * k + 1, pairs.sparkSession.sparkContext.broadcast(cls)
    schema = pa.schema([("group", pa.int32()), ("cells", pa.binary()), ("ns", pa.binary())])

    def counted(cells: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(n_head * width, np.int64), []  # the one large array that a task holds
        for cell, n in cells:
            np.add.at(total, cell.astype(np.int64), n.astype(np.int64))
        for group, low in enumerate(range(0, len(total), GROUP * width)):
            own = total[low : low + GROUP * width]
            cell = np.flatnonzero(own)
            if len(cell):
                rows.append((group, cell.astype(np.int32).tobytes(), own[cell].tobytes()))
            if len(rows) == 100:
                yield to_batch(rows, schema)
                rows = []
        if rows:
            yield to_batch(rows, schema)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value

        def cells():
            for b in batches:
                for row in b.to_pylist():
                    l, r, n = unpacked(row, np.int32)  # noqa: E741
                    a, z, same = l < n_head, r < n_head, (l == r) & (l < n_head)
                    yield l[a] * width + of[r[a]], n[a]
                    yield r[z] * width + k + of[l[z]], n[z]
                    yield l[same] * width + 2 * k, n[same]

        return counted(cells())

    def of_tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells():
            for b in opened(batches):
                codes = b.column("codes")
                own = np.repeat(b.column("cls").to_numpy(), np.diff(codes.offsets.to_numpy())).astype(np.int64)
                flat, n = codes.flatten().to_numpy().astype(np.int64), b.column("ns").flatten().to_numpy().astype(np.int64)
                place, before = flat % (n_head + 1), flat > n_head
                some = place < n_head
                # What follows the tail word has it on its left, and the other way round.
                yield (place * width + np.where(before, 0, k) + own)[some], n[some]

        return counted(cells())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(group: int, sums: np.ndarray) -> pa.RecordBatch:
            cell = np.flatnonzero(sums)
            return closed(next(gathered(iter([(group * GROUP + cell // width, cell % width, sums[cell])]), lambda keys: shared.value[keys])))

        group, sums = None, np.zeros(GROUP * width, np.int64)
        for b in batches:
            for row in b.to_pylist():
                if group is not None and row["group"] != group:
                    yield finished(group, sums)
                    sums = np.zeros(GROUP * width, np.int64)
                group = row["group"]
                sums[np.frombuffer(row["cells"], np.int32)] += np.frombuffer(row["ns"], np.int64)
        if group is not None:
            yield finished(group, sums)

    fields = "group int, cells binary, ns binary"
    rows = pairs.filter("bucket < 0").mapInArrow(of_pairs, fields).unionAll(tail.mapInArrow(of_tail, fields))
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(total, CONTEXTS)


def dense(b: pa.RecordBatch, columns: np.ndarray | None, width: int) -> np.ndarray:
    """Counts of classes beside each word of contexts; ``columns`` gives the cell of each code."""
    codes, n = b.column("codes"), b.num_rows
    flat = codes.flatten().to_numpy()
    cell = np.repeat(np.arange(n) * width, np.diff(codes.offsets.to_numpy())) + (flat if columns is None else columns[flat])
    return np.bincount(cell, b.column("ns").flatten().to_numpy(), n * width).reshape(n, width)


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of contexts with about CELLS entries."""
    sizes = np.cumsum(np.diff(b.column("codes").offsets.to_numpy()) + 1)
    cuts = np.r_[0, 1 + np.flatnonzero(np.diff(sizes // CELLS)), b.num_rows]
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield b.slice(low, high - low)


def class_table(contexts: list[tuple[DataFrame, object]], k: int) -> np.ndarray:
    """Counts of adjacent classes, the last being the end's, from contexts and the broadcast cells of their codes (or None)."""

    def adder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k)
            for b in opened(batches):
                codes, n = b.column("codes"), b.column("ns").flatten().to_numpy()
                own, flat = np.repeat(b.column("cls").to_numpy().astype(np.int64), np.diff(codes.offsets.to_numpy())), codes.flatten().to_numpy()
                beside = flat if shared is None else shared.value[flat]
                after, first = beside < k, beside == 2 * k - 1  # what follows the word, and the end before it
                total += np.bincount(own[after] * k + beside[after], n[after], k * k)
                total[(k - 1) * k :] += np.bincount(own[first], n[first], k)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

        return run

    sides = [df.mapInArrow(adder(shared), "cell long, n long") for df, shared in contexts]
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionAll(more)
    table = np.zeros(k * k)
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k, k)


def choose(contexts: DataFrame, shared, table: np.ndarray, classes: int, half: int | None = None, whole: bool = True) -> DataFrame:
    """Contexts (if not ``whole``, key and cls alone) with the class that each word chooses against ``table``; with ``half``, only words whose key has that remainder move.

    No second Python function reads what this one returns in the same task: each would have a worker of its own, which stays and takes memory.
    """
    k, seen = len(table), contexts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in opened(batches):
            for b in slices(stretch):
                cls, counts = b.column("cls").to_numpy().astype(np.int64), dense(b, shared and shared.value, 2 * k + 1)
                best = best_classes(seen.value, cls, counts[:, :k], counts[:, k : 2 * k], counts[:, 2 * k], classes)
                if half is not None:
                    best = np.where(b.column("key").to_numpy() % 2 == half, best, cls)
                b = b.set_column(1, "cls", pa.array(best, pa.int32()))
                yield closed(b) if whole else b.select(["key", "cls"])

    return contexts.mapInArrow(run, CONTEXTS if whole else "key long, cls int")


def seed_table(pairs: DataFrame, n_head: int, clustered: int) -> np.ndarray:
    """Counts of adjacent units: the first ``clustered`` words, then all other head words in one, then the end."""
    rest, end = clustered, clustered + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((end + 1) ** 2, np.int64)
        for b in batches:
            for row in b.to_pylist():
                l, r, n = unpacked(row, np.int32)  # noqa: E741
                a, z = (np.where(x == n_head, end, np.minimum(x, rest)).astype(np.int64) for x in (l, r))
                np.add.at(total, a * (end + 1) + z, n)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    seen = pairs.filter("bucket < 0").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    units = np.zeros((end + 1) ** 2, np.int64)
    units[seen.column("cell").to_numpy()] = seen.column("n").to_numpy()
    return units.reshape(end + 1, end + 1)


def cluster(train: DataFrame, head: list[bytes], n_others: int, clustered: int, classes: int, scratch: Scratch, turns: tuple[str, ...] = TURNS) -> tuple[np.ndarray, DataFrame, int]:
    """Class of each head word, (key, cls) of all others by their hash, and the number of classes. All others occur ``n_others`` times."""
    sc, n_head = train.sparkSession.sparkContext, len(head)
    pairs = scratch.table("pairs", word_pairs(train, head, 1 + n_others // BUCKET))
    clustered = min(clustered, n_head)
    units = seed_table(pairs, n_head, clustered)
    seed = exchange(units, clustered, classes)
    classes = max(1, min(classes, clustered))
    k = classes + 2  # word classes, words without a class yet, the end
    cls = np.r_[seed[:clustered], np.full(n_head - clustered, classes), k - 1].astype(np.int64)
    tail = scratch.table("tail", tail_contexts(pairs, n_head, classes))
    sc._jvm.System.gc()  # lets Spark delete shuffle files that are done with, which would add up

    def read(turn: int) -> tuple[DataFrame, object, np.ndarray]:
        around = scratch.table(f"head{turn}", head_contexts(pairs, tail, cls, k))
        columns = sc.broadcast(np.r_[cls, k + cls])
        return around, columns, class_table([(around, None), (tail, columns)], k)

    before, old = None, ["tail"]
    for turn, who in enumerate(turns):
        around, columns, table = read(turn)
        if before is not None and turns[turn - 1] in ("even", "odd") and information(table) <= before[0]:
            cls = before[1]  # half of the head made it worse; what follows starts from what was
            around, columns, table = read(turn)
        before = information(table), cls
        if who == "tail":
            name = f"tail{turn}"
            tail = scratch.table(name, choose(tail, columns, table, classes))
            scratch.drop(*old)
            old = [name]
        else:
            half = {"even": 0, "odd": 1}.get(who)
            moved = choose(around, None, table, classes, half, whole=False).toArrow()
            cls = cls.copy()
            cls[moved.column("key").to_numpy()] = moved.column("cls").to_numpy()
            cls[:n_head][cls[:n_head] >= classes] = 0
        scratch.drop(f"head{turn}")
        sc._jvm.System.gc()
    scratch.drop("pairs")
    return cls[:n_head], classes_of(tail), classes


@dataclass(frozen=True)
class Model:
    """What scoring needs; sizes are bounded by HEAD and the number of classes."""

    index: dict[bytes, int]
    log_counts: np.ndarray  # log10(count + 1) of each head word
    classes: np.ndarray  # of each head word, then what stands for a word that training lacks
    emit: np.ndarray  # log10 P(word | class) of each head word, then 0: steps hold all of a word that training lacks
    mass: np.ndarray  # what emissions of each class are divided by
    end_class: int
    end_log_count: float
    n_tokens: int
    n_types: int


def train(docs: DataFrame, vocabulary: DataFrame, head_size: int, clustered: int, classes: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model but for its transitions, and (word, c, cls) of every tail word. ``vocabulary`` holds (word, n) of docs."""
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head, counts, others = split_head(vocabulary, head_size)
    cls, tail, classes = cluster(docs, head, int(n_words - counts.sum()), clustered, classes, scratch)
    classed = scratch.table("classed", others.withColumn("key", F.xxhash64("word")).join(tail, "key").select("word", F.col("n").alias("c"), "cls"))
    mass = 1 + np.bincount(cls, counts + 1, classes)
    for r in classed.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        mass[r["cls"]] += r["n"] + r["types"]
    ends = docs.count()
    return Model(
        {w: i for i, w in enumerate(head)}, np.log10(counts + 1), np.r_[cls, classes + 1], np.r_[np.log10(counts + 1) - np.log10(mass)[cls], 0.0], mass,
        classes, float(np.log10(ends + 1)), int(n_words + ends), int(n_types + (ends > 0)),
    ), classed


UNKNOWN = 255  # in a document's class sequence, a word outside the head


SPELLED = 50_000  # tail words that a task looks up in at a time, about
ASKED = 1_000_000  # occurrences of tail words that a bucket looks up, about
BLOCK = 60_000  # words outside the head in a block of texts, about
LOOKUP = "bucket int, kind int, block long, words binary, a binary, b binary"
_LOOKUP_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def dealt(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bucket, places, words with a space between) of each bucket of words."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(of, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(places):
            yield int(of[places[0]]), places, b" ".join([words[i] for i in places.tolist()])


def encode(docs: DataFrame, classed: DataFrame, model: Model, is_held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, count_log, emit_log, seq): each text's classes, and the sums that need no transitions.

    Words outside the head are looked up by bucket: each block of texts sends the words of a bucket in one row, and gets their counts and classes back in one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # As many buckets as the words to spell and their places need, so that neither a bucket nor a task's share grows with the corpus.
    n_tail = max(0, model.n_tokens - round(float((10**model.log_counts - 1).sum())))
    buckets = 1 + max((model.n_types - len(model.index)) // SPELLED, n_tail // ASKED)
    own_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("seq", pa.binary()), ("known", pa.int64()), ("head_log", pa.float64()), ("emit_log", pa.float64())])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, cls = [], [], []

        def out() -> pa.RecordBatch:
            n, of = np.concatenate(c), np.concatenate(cls)
            return to_batch([(bucket, 0, None, text, n[at].tobytes(), of[at].tobytes()) for bucket, at, text in dealt(words, buckets)], _LOOKUP_SCHEMA)

        for b in batches:
            words.extend(listed(b.column(0).cast(pa.binary())))
            c.append(b.column(1).to_numpy())
            cls.append(b.column(2).to_numpy())
            if len(words) > BLOCK:
                yield out()
                words, c, cls = [], [], []
        if words:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, made = shared.value, TaskContext.get().partitionId(), 0
        head, own, words, spots, size = pa.array(list(m.index), pa.binary()), [], [], [], 0
        codes = np.r_[m.classes[:-1], UNKNOWN].astype(np.uint8)

        def out() -> pa.RecordBatch:
            texts, at = to_batch(own, own_schema), np.concatenate(spots).astype(np.int32)
            whole = texts.serialize().to_pybytes()
            # Named by place and content: should a task that is run again read its rows in another order, blocks would lack their words, which is an error.
            block = xxhash.xxh3_64_intdigest(whole, (task << 32) + made) >> 1
            rows = [(bucket, 1, block, text, at[x].tobytes(), None) for bucket, x, text in dealt(words, buckets)]
            return to_batch([(block % buckets, 2, block, None, whole, np.int64(len(words)).tobytes()), *rows], _LOOKUP_SCHEMA)

        for b in batches:
            found, at = tokens(b)
            placed = places(found, head)
            rest, gone = listed(found.filter(pa.array(placed < 0))), 0
            for doc_id, is_held, low, high in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = placed[low:high]
                known, other = ids[ids >= 0], np.flatnonzero(ids < 0)
                whole = np.r_[np.uint8(m.end_class), codes[ids], np.uint8(m.end_class)].astype(np.uint8).tobytes()
                own.append((doc_id, is_held, whole, len(known) + (m.end_log_count > 0), float(m.log_counts[known].sum()) + m.end_log_count, float(m.emit[known].sum())))
                spots.append(other + 1 + size)
                words.extend(rest[gone : gone + len(other)])
                gone += len(other)
                size += len(whole)
                if len(words) > BLOCK or size > 20 * BLOCK:
                    yield out()
                    own, words, spots, size, made = [], [], [], 0, made + 1
        if own:
            yield out()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, places, c, cls = None, {}, [], []
        for b in batches:
            for i in range(b.num_rows):
                of, kind, block, words, first, second = (column[i] for column in b.columns)
                if of.as_py() != bucket:
                    bucket, places, c, cls = of.as_py(), {}, [np.zeros(1, np.int64)], [np.full(1, -1, np.int32)]
                if kind.as_py() == 0:
                    named = words.as_py().split(b" ")
                    places.update(zip(named, range(len(places) + 1, len(places) + len(named) + 1), strict=True))
                    c.append(np.frombuffer(first.as_buffer(), np.int64))
                    cls.append(np.frombuffer(second.as_buffer(), np.int32))
                elif kind.as_py() == 1:
                    c, cls = [np.concatenate(c)], [np.concatenate(cls)]  # place 0 is that of a word that training lacks
                    at = np.array([places.get(w, 0) for w in words.as_py().split(b" ")], np.int64)
                    yield to_batch([(bucket, 1, block.as_py(), c[0][at].tobytes(), first.as_py(), cls[0][at].tobytes())], _LOOKUP_SCHEMA)
                else:
                    yield to_batch([(bucket, 0, block.as_py(), None, first.as_py(), second.as_py())], _LOOKUP_SCHEMA)

    def finished(whole: bytes, n: int, found: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        m, b = shared.value, pa.ipc.read_record_batch(pa.py_buffer(whole), own_schema)
        log_mass, n_docs, seq = np.r_[np.log10(m.mass), 0.0, 0.0], b.num_rows, b.column("seq")
        lengths = np.array([len(x) for x in seq.to_pylist()], np.int64)
        c, at, own = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int32, np.int32), strict=True))
        if len(at) != n:
            raise RuntimeError("a block of texts lacks words: its rows came in another order when a task was run again")
        order = np.argsort(at)
        c, at, own = c[order], at[order], own[order]
        cls, ends = np.frombuffer(b"".join(seq.to_pylist()), np.uint8).copy(), np.cumsum(lengths)
        of = np.searchsorted(ends, at, side="right")
        cls[at] = np.where(own < 0, m.classes[-1], own)
        added = lambda values: np.bincount(of, values, n_docs)
        rest_log, known = added(np.log10(c + 1.0)), b.column("known").to_numpy() + added(c > 0).astype(np.int64)
        emit_log = b.column("emit_log").to_numpy() + rest_log - added(log_mass[cls[at]])
        text = cls.tobytes()
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), pa.array(lengths - 1), pa.array(known, pa.int64()), pa.array(b.column("head_log").to_numpy() + rest_log), pa.array(emit_log), pa.array([text[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "count_log", "emit_log", "seq"],
        )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, whole, n, found = None, None, 0, []
        for b in batches:
            for i in range(b.num_rows):
                _, kind, of, counts, first, second = (column[i].as_py() for column in b.columns)
                if kind == 0:
                    if block is not None:
                        yield finished(whole, n, found)
                    block, whole, n, found = of, first, int(np.frombuffer(second, np.int64)[0]), []
                elif of != block:
                    raise RuntimeError("words of a block whose texts are not there")
                else:
                    found.append((counts, first, second))
        if block is not None:
            yield finished(whole, n, found)

    blocks = text_rows(docs).withColumn("held_out", is_held_out).mapInArrow(run, LOOKUP)
    rows = classed.select("word", F.col("c").cast("long"), F.col("cls").cast("int")).mapInArrow(spelled, LOOKUP).unionAll(blocks)
    known = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(look_up, LOOKUP)
    by_block = known.repartition(buckets, "block").sortWithinPartitions("block", "kind")
    return by_block.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, count_log double, emit_log double, seq binary")


def transitions(encoded: DataFrame, classes: int) -> np.ndarray:
    """Counts of adjacent classes over the training texts; the last class is the end's."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            for seq in b.column(0).to_pylist():
                cls = np.frombuffer(seq, np.uint8).astype(np.int64)
                total += np.bincount(cls[:-1] * k + cls[1:], minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

    found = encoded.filter("NOT held_out").select("seq").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k, k)


def smoothed(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | previous class) and P(class): class unigrams are mixed in by the weight under which each pair, left out of its own count, is most likely."""
    prior = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    i, j = np.nonzero(pairs)
    n, total = pairs[i, j], pairs.sum(1)[i]
    chance = lambda weight: float((n * np.log((n - 1 + weight * prior[j]) / (total - 1 + weight))).sum())
    weight = max((2.0**x for x in range(-2, 31)), key=chance)
    return (pairs + weight * prior) / (pairs.sum(1, keepdims=True) + weight), prior


def score(encoded: DataFrame, model: Model, pairs: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    chance, prior = smoothed(pairs)
    after = np.vstack([chance, prior])  # what follows a word that training lacks has class unigrams
    steps = np.c_[np.log10(after), np.log10((after[:, :-1] / model.mass).sum(1))]  # the last column is such a word itself
    shared = encoded.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [np.frombuffer(x, np.uint8) for x in b.column("seq").to_pylist()]
            moved = np.array([shared.value[x[:-1], x[1:]].sum() for x in of])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(b.column("emit_log").to_numpy() + moved, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "count_log", "score"])

    sums = encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, count_log double, score double")
    base = F.col("count_log") - F.col("n_tokens") * F.log10(F.lit(float(model.n_tokens + model.n_types + 1)))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_by_classes(docs: DataFrame, is_held_out, head_size: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """Scores of all documents by a model of those that are not held out. Classes are numbers of a byte, of which three are taken."""
    if classes > 253:
        raise ValueError("at most 253 classes")
    scratch, known = Scratch(docs.sparkSession), docs.filter(~is_held_out)
    with short_batches(docs.sparkSession):
        vocabulary = scratch.table("vocabulary", word_counts(known))
        model, classed = train(known, vocabulary, head_size, clustered, classes, scratch)
        encoded = scratch.table("encoded", encode(docs, classed, model, is_held_out))
        return score(encoded, model, transitions(encoded, model.end_class))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_by_classes(documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2))
