"""Operator 2: substring dedup with repeated-phrase automata.

A window is 20 consecutive words. A word is removed if it lies in a window whose word sequence also starts earlier.

Copies come first: a document of 20 words or more whose whole word sequence (its SHA-256) has an earlier place is a candidate copy, whose
windows need no counting, as no first start lies in it. It is compared word for word with the first such document before it loses its words, and would keep them
if they differed.

1. Anchors narrow the search: of the 15 six-word grams of each window the one with the least hash, the leftmost of equals, is its anchor.
   The choice depends on the window's words alone, so equal windows have equal anchors, and windows whose anchor is found
   once, copies aside, cannot recur. About an eighth of the words start an anchor.
2. Windows with a recurring anchor are counted by a 96-bit hash; those found twice or more are the confirmed
   passages, each with its first place and the blocks of documents in which it is found.
3. Documents are dealt into blocks by a hash of the doc_id. Each block's shard is compiled with pyahocorasick from the passages that are found in it, cut from
   the texts that hold them first, and all documents of the block stream through it once. It finds the passages' anchors, and the words around
   them are compared, so each occurrence is exact; those that are not the first one remove their words.

No hash alone removes a word: each one is followed by a comparison of the words. Hashes are not polynomials, under which texts of a regular build would collide.

Scale: the shards together hold each passage once for each block it occurs in, so they grow with the repeated text and not with
documents times passages; a shard is bounded by the block, whose number follows the corpus, and a task handles about BLOCKS_A_TASK of them. Counts combine before the shuffle. A passage that a third of
all documents share is one row for each block. Documents without a recurring anchor skip steps 2 and 3.

Defined cases: null and empty texts have no words (digest of the empty string); fewer than 20 words are never removed; rows
that share a doc_id and a text get equal results, judged as one document; rows that share a doc_id but not the text are documents of their own, in the order of a
hash of the text; a null doc_id has no place among the others, so such a
row neither loses words nor takes any from others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, byte_texts, documents, text_rows, to_batch

WINDOW, GRAM = 20, 6
BLOCK_WORDS = 400_000
BLOCKS_A_TASK = 16
PIECE = 1 << 20
LONG_WORD = 512  # bytes; longer words are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishes a hash in place, so that all bits depend on all of it."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """The words of a column of texts, as byte ranges of its buffer: no object is made for a word."""

    def __init__(self, column: pa.Array):
        large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        n, solid = len(self.data), ~SPACES[self.data]
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = ~solid[:-1]
        last[:-1] = ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[inner], last[inner - 1] = True, True
        self.starts, self.ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
        #: Word bounds[i]..bounds[i + 1] - 1 are those of text i.
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.texts = np.repeat(np.arange(len(column)), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time; words of up to eight bytes and equal length never collide."""
        sizes = self.ends - self.starts
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        lanes = np.ndarray(len(self.data) + 1, np.dtype("<u8"), padded, 0, (1,))
        out = mixed(sizes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        open_, at = np.flatnonzero(sizes <= LONG_WORD), 0
        while len(open_):
            left = sizes[open_] - at
            lane = lanes[self.starts[open_] + at] & LANE_MASKS[np.minimum(left, 8)]
            out[open_] = mixed((out[open_] ^ lane) * np.uint64(0xD1342543DE82EF95))
            open_, at = open_[left > 8], at + 8
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def digests(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a 128-bit hash of each text's whole sequence of words."""
        found = [xxhash.xxh3_128_intdigest(hashes[low:high].tobytes()) for low, high in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]
        return tuple(np.array([x >> shift & (1 << 64) - 1 for x in found], np.uint64).view(np.int64) for shift in (64, 0))

    def windows(self) -> np.ndarray:
        """Words that start a window of their text."""
        at = np.arange(len(self.starts))
        return at[at + WINDOW <= self.bounds[1:][self.texts]]

    def between(self, first: int, last: int) -> bytes:
        """The text from a word to another, as it stands."""
        return self.data[self.starts[first] : self.ends[last]].tobytes()


def rolled(hashes: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, by doubling; mixed at each step, so that it is no polynomial."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, width = None, 0, hashes, 1
    joined = lambda left, right: mixed(left * np.uint64(factor) + right)
    while True:
        if size & width:
            out = part[:n].copy() if out is None else joined(out, part[done : done + n])
            done += width
        if 2 * width > size:
            return mixed(out)
        part = joined(part[:-width], part[width:])
        width *= 2


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and for each window the place of its anchor."""
    grams = rolled(hashes, GRAM, 0xD6E8FEB86659FD93)
    n, span = len(hashes) - WINDOW + 1, WINDOW - GRAM + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    at, width = np.arange(len(grams)), 1
    while width < span:  # least, leftmost of equals, of the next ``width`` grams; the last step overlaps
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        width += step
    return grams, at


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = rolled(hashes, WINDOW, 0xA0761D6478BD642F).view(np.int64)
    second = (rolled(hashes, WINDOW, 0xE7037ED1A0B428DB) >> np.uint64(33)).astype(np.int32)
    return first, second


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about PIECE bytes of text each, or one longer text."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, 1 + np.flatnonzero(np.diff(sizes // PIECE)), len(sizes)]) if len(sizes) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(low, high - low)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of set flags, and the place after its last one."""
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


KEY = ["doc_id", "tag"]  # a document: its id, and a hash of its text to tell apart rows that share the id


def keyed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("tag", F.xxhash64("text"))


def digest_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, digest) of each document that has a window: the SHA-256 of its words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            tokens = [raw.split() for raw in byte_texts(b)]
            some = [i for i, words in enumerate(tokens) if len(words) >= WINDOW]
            digests = pa.array([hashlib.sha256(b" ".join(tokens[i])).digest() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some, pa.int64())) for c in (0, 2)), digests], names=["doc_id", "tag", "digest"])

    return texts.mapInArrow(run, "doc_id long, tag long, digest binary")


def later_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, first): each document whose whole sequence of words, 20 or more, is that of an earlier one, its first such (doc_id, tag)."""
    rows = digest_rows(texts)
    place = F.struct(*KEY)
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    return rows.join(first, "digest").filter(place > F.col("first")).select(*KEY, "first")


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(h, doc_id, tag, digest, again): anchors of each document, its digest, and whether it has the anchor in two places."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("digest", pa.int64()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            hashes = words.hashes()
            grams, at = anchors(hashes)
            places = np.unique(at[words.windows()])
            h, text = grams[places].view(np.int64), words.texts[places]
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
            first = np.flatnonzero(np.r_[True, ~same][: len(h)])
            again = np.r_[same, False][first]
            arrays = (h[first], *(b.column(c).to_numpy()[text[first]] for c in (0, 2)), words.digests(hashes)[0][text[first]], again)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=schema)

    return texts.mapInArrow(run, "h long, doc_id long, tag long, digest long, again boolean")


def candidate_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """All documents with their result, or their text with what it may repeat: the stretches (low, high, low, high, ...) of windows whose anchor recurs, or its first copy."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("stretches", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(2))
            grams, at = anchors(words.hashes())
            starts, n = words.windows(), len(words.starts)
            # Whether an anchor recurs is a fact of the corpus, so the texts' lists can be united.
            flags, listed = np.zeros(n, bool), b.column(3).is_valid().to_numpy(zero_copy_only=False)
            flags[starts] = listed[words.texts[starts]] & np.isin(grams[at[starts]], np.unique(b.column(3).flatten().to_numpy(zero_copy_only=False)).view(np.uint64))
            low, high = stretches(flags)  # never over two texts, whose last windows start 19 words before the end
            of, rows = words.texts[low], []
            own = np.searchsorted(of, np.arange(len(b) + 1))
            for i, (doc_id, tag, first, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), byte_texts(b), strict=True)):
                count = int(words.bounds[i + 1] - words.bounds[i])
                if first is not None:
                    rows.append((doc_id, tag, count, None, raw, None, first))
                elif own[i] == own[i + 1]:
                    rows.append((doc_id, tag, count, hashlib.sha256(b" ".join(raw.split())).hexdigest(), None, None, None))
                else:
                    ends = np.stack([low[own[i] : own[i + 1]], high[own[i] : own[i + 1]]], axis=1).ravel() - words.bounds[i]
                    rows.append((doc_id, tag, count, None, raw, ends.astype(np.int32), None))
            yield to_batch(rows, schema.append(pa.field("first", b.column(4).type)))

    fields = "doc_id long, tag long, n_words long, kept_sha256 string, text string, stretches array<int>, first struct<doc_id: long, tag: long>"
    found = found.select(*(F.col(c).alias(f"found_{c}") for c in KEY), "anchors", "first")
    joined = texts.join(found, (texts["doc_id"] == F.col("found_doc_id")) & (texts["tag"] == F.col("found_tag")), "left").select(*KEY, "text", "anchors", "first")
    return joined.mapInArrow(run, fields)


def window_rows(held: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, tag, start, block) of each window whose anchor recurs."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = Words(b.column(1))
            first, second = window_hashes(words.hashes())
            ends = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2) + np.repeat(words.bounds[:-1], pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False) // 2)[:, None]
            marks = np.zeros(len(words.starts) + 1, np.int8)
            np.add.at(marks, ends[:, 0], 1)
            np.add.at(marks, ends[:, 1], -1)
            at = np.flatnonzero(np.cumsum(marks[:-1], dtype=np.int8))
            text = words.texts[at]
            doc_id, tag, block = (b.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 3, 4))
            arrays = (first[at], second[at], doc_id, tag, (at - words.bounds[text]).astype(np.int32), block)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=schema)

    return held.filter("stretches IS NOT NULL").select("doc_id", "text", "stretches", "tag", "block").mapInArrow(run, "h1 long, h2 int, doc_id long, tag long, start int, block int")


def passages(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """(block, doc_id, tag, start, phrase, cuts): for each block, the stretches of first places whose windows are found in it.

    ``cuts`` holds, for each anchor of the phrase, its place and the first of the windows that have it. ``wanted`` has a row (document, block, starts) for
    each block that a document's first places are found in; without starts the whole text is wanted, to compare copies with.
    """
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("phrase", pa.string()), ("cuts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, rows = Words(b.column(1)), []
            at = anchors(words.hashes())[1]
            for i, (doc_id, tag, block, starts) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                base = int(words.bounds[i])
                if starts is None:
                    rows.append((block, doc_id, tag, 0, words.between(base, int(words.bounds[i + 1]) - 1), None))
                    continue
                own = np.sort(np.array(starts, np.int64)) + base
                edges = np.r_[0, np.flatnonzero(np.diff(own) != 1) + 1, len(own)].tolist()
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    first, last = int(own[low]), int(own[high - 1])
                    places = at[first : last + 1]
                    turns = np.r_[0, np.flatnonzero(np.diff(places)) + 1]
                    cuts = np.stack([places[turns] - first, turns], axis=1).ravel().astype(np.int32)
                    rows.append((block, doc_id, tag, first - base, words.between(first, last + WINDOW - 1), cuts))
                if len(rows) > 2000:
                    yield to_batch(rows, schema)
                    rows = []
            if rows:
                yield to_batch(rows, schema)

    joined = held.select(*KEY, "text").dropDuplicates(KEY).join(wanted, KEY).select("doc_id", "text", "tag", "block", "starts")
    return joined.mapInArrow(run, "block int, doc_id long, tag long, start int, phrase string, cuts array<int>")


class Shard:
    """The automaton of one block. Its patterns are the anchors of the passages' windows, so it holds an eighth as many patterns as
    there are windows, each a third as long; what surrounds an anchor that is found is compared word for word.

    Words are written as three symbols of 128, since the automaton searches a node's children one by one.
    """

    def __init__(self):
        self.codes: dict[bytes, str] = {}
        self.phrases: list[tuple[tuple[int, int], int, list[bytes]]] = []
        self.whole: dict[tuple[int, int], list[bytes]] = {}
        self.anchors: dict[str, list[tuple[int, int, int, int]]] = {}
        self.tables: dict[str, dict[tuple, tuple]] = {}
        self.automaton = None

    def code(self, word: bytes) -> str:
        found = self.codes.get(word)
        if found is None:
            n = len(self.codes) + 1
            found = self.codes[word] = chr(n >> 14) + chr(n >> 7 & 127) + chr(n & 127)
        return found

    def add(self, document: tuple[int, int], start: int, phrase: bytes, cuts: list[int] | None) -> None:
        """A passage of a document, or without ``cuts`` its whole text."""
        tokens = phrase.split()
        if cuts is None:
            self.whole[document] = tokens
            return
        number = len(self.phrases)
        self.phrases.append((document, start, tokens))
        for place, low, high in zip(cuts[::2], cuts[1::2], [*cuts[3::2], len(tokens) - WINDOW + 1], strict=True):  # windows low..high-1 share an anchor
            key = "".join(map(self.code, tokens[place : place + GRAM]))
            self.anchors.setdefault(key, []).append((number, place, low, high))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key in self.anchors:
            self.automaton.add_word(key, key)
        self.automaton.make_automaton()

    def table(self, key: str) -> dict[tuple, tuple]:
        """Windows of an anchor that many passages share, by their words: one look-up in place of many comparisons."""
        found = self.tables.get(key)
        if found is None:
            found = self.tables[key] = {}
            for number, _, low, high in self.anchors[key]:
                document, start, tokens = self.phrases[number]
                for k in range(low, high):
                    found[tuple(tokens[k : k + WINDOW])] = (document, start + k)
        return found

    def occurrences(self, tokens: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        """(first start, last start + 1, first place of the first start) of occurrences of passages' windows."""
        get, n = self.codes.get, len(tokens)
        for end, key in self.automaton.iter("".join([get(w, "\0\0\0") for w in tokens])):
            if end % 3 != 2:
                continue
            place = end // 3 - GRAM + 1
            shared = self.anchors[key]
            if len(shared) > 8:
                table = self.table(key)
                for k in range(max(0, place + GRAM - WINDOW), min(place, n - WINDOW) + 1):
                    first = table.get(tuple(tokens[k : k + WINDOW]))
                    if first is not None:
                        yield k, k + 1, first
                continue
            for number, own, low, high in shared:
                document, start, phrase = self.phrases[number]
                shift = place - own
                if low + shift >= 0 and tokens[low + shift : high + shift + WINDOW - 1] == phrase[low : high + WINDOW - 1]:
                    yield low + shift, high + shift, (document, start + low)
                    continue
                for k in range(max(low, -shift), high):
                    if tokens[k + shift : k + shift + WINDOW] == phrase[k : k + WINDOW]:
                        yield k + shift, k + shift + 1, (document, start + k)

    def removed(self, document: tuple[int, int], tokens: list[bytes], first: tuple[int, int] | None) -> np.ndarray:
        """Mask of the words inside occurrences that are not the first one; all of them in a copy of ``first``."""
        if first is not None:
            return np.full(len(tokens), self.whole[first] == tokens)
        mask = np.zeros(len(tokens), bool)
        if self.anchors:
            if self.automaton is None:
                self.compile()
            for low, high, place in self.occurrences(tokens):
                if place != (document, low):
                    mask[low : high + WINDOW - 1] = True
        return mask


def streamed(held: DataFrame, phrases: DataFrame, n_blocks: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of the documents that may hold repeats.

    Rows of a block arrive in one task, its passages before its documents, and are handled as they come; a task may have many blocks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = Shard(), None
        for b in batches:
            rows = []
            for block, is_doc, doc_id, tag, start, cuts, first, raw in zip(*(b.column(i).to_pylist() for i in range(7)), byte_texts(b), strict=True):
                if block != current:
                    shard, current = Shard(), block
                if not is_doc:
                    shard.add((doc_id, tag), start, raw, cuts)
                    continue
                tokens = raw.split()
                mask = shard.removed((doc_id, tag), tokens, first and (first["doc_id"], first["tag"]))
                kept = b" ".join(w for w, gone in zip(tokens, mask.tolist(), strict=True) if not gone)
                rows.append((doc_id, len(tokens), int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield to_batch(rows, schema)

    nothing = lambda kind: F.lit(None).cast(kind)
    both = phrases.select("block", F.lit(False).alias("is_doc"), *KEY, "start", "cuts", nothing("struct<doc_id: long, tag: long>").alias("first"), F.col("phrase").alias("text"))
    both = both.unionByName(held.select("block", F.lit(True).alias("is_doc"), *KEY, F.lit(0).alias("start"), nothing("array<int>").alias("cuts"), "first", "text"))
    tasks = max(min(n_blocks, held.sparkSession.sparkContext.defaultParallelism), n_blocks // BLOCKS_A_TASK)
    dealt = both.repartition(tasks, "block").sortWithinPartitions("block", "is_doc")
    return dealt.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup_substrings(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept is null where nothing can have been removed."""
    scratch = Scratch(docs.sparkSession)
    texts = keyed(text_rows(docs))
    named = texts.filter("doc_id IS NOT NULL")
    copies = later_copies(named).select(*KEY, F.lit(None).cast("long").alias("h"), "first")
    grams = anchor_rows(named)
    by_anchor = grams.groupBy("h").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.max("again").alias("again"))
    recurring = scratch.table("recurring", by_anchor.filter("again OR least <> most").select("h"))
    marks = grams.join(recurring, "h", "left_semi").select(*KEY, "h", F.lit(None).cast("struct<doc_id: long, tag: long>").alias("first")).unionByName(copies)
    found = scratch.table("found", marks.groupBy(*KEY).agg(F.collect_set("h").alias("anchors"), F.max("first").alias("first")))
    held_or_done = scratch.table("candidates", candidate_texts(texts, found))
    scratch.drop("recurring", "found")
    words = held_or_done.filter("text IS NOT NULL").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_blocks = 1 + words // block_words
    held = held_or_done.filter("text IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    counted = window_rows(held).groupBy("h1", "h2").agg(F.min(F.struct(*KEY, "start")).alias("at"), F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("blocks"))
    shared = counted.filter("n > 1").select("at.doc_id", "at.tag", "at.start", F.explode("blocks").alias("block"))
    whole = held.filter("first IS NOT NULL").select("first.doc_id", "first.tag", "block", F.lit(None).cast("array<int>").alias("starts")).distinct()
    wanted = scratch.table("wanted", shared.groupBy(*KEY, "block").agg(F.collect_list("start").alias("starts")).unionByName(whole))
    phrases = scratch.table("phrases", passages(keyed(text_rows(docs)), wanted))
    done = held_or_done.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return streamed(held, phrases, int(n_blocks)).unionByName(done)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("kept")
