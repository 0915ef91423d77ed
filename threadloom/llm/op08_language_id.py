"""Operator 8: language ID by segmentation-marginalised unigrams.

The vocabulary is a fixed public one (its file is a parameter; only its pieces are used, nothing is added). Each language
has a probability for each piece. A word's likelihood is the sum over all ways to cut it into pieces of the product of their
probabilities, by the forward algorithm; a text's is the product over its words. Words are runs of letters,
lower-cased, with the vocabulary's word-start mark; characters that are in no piece have a fixed small probability.

Piece probabilities come from expectation maximisation: forward and backward sums give each piece's expected count in the
training words of each language, in ``ROUNDS`` rounds from uniform pieces, with add-half smoothing.

Words are never cut, however long. So that long ones don't underflow, the forward sums that are still in use are brought back to 1 every ``RESCALE`` letters, their
logarithm being kept; expected counts of long words are summed as logarithms.

Training reads a documented sample: about ``SAMPLE`` = 1500 training documents of each language, all of them where
there are fewer, chosen by a hash of the doc_id against the language's count. All documents are scored, on whole texts.

Scale: word counts per (language, word) are combined before the shuffle; expected counts reduce to at most
vocabulary x languages rows, the only thing the driver gathers. Scoring is one pass: a block's new words are scored side by
side, and each distinct word's vector of likelihoods is kept in a cache of bounded size.

Defined cases: null texts, texts without a letter, and any text if no training document has a language give und with score
0; ties go to the language first by code point; a null lang is not learned; an empty table gives an empty result;
other columns (lang and source too) are never read when predicting.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, arrow_rows, documents, held_out, to_batch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
SAMPLE, ROUNDS, CACHE_WORDS, RESCALE = 1500, 3, 300_000, 16
BLOCK = 500  # texts whose new words are scored side by side
WORD = re.compile(r"[^\W\d_]+")
FLOOR = 1e-9  # of a character that is in no piece


def public_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def added(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    low, high = (x, y) if x < y else (y, x)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class Lattice:
    """Forward and backward sums over a piece table: piece -> probabilities, one for each language."""

    def __init__(self, table: dict[str, tuple[float, ...]], n: int):
        self.table, self.n = table, n
        self.longest = max(map(len, table), default=1)
        self.floor = (FLOOR,) * n
        self.rows = np.array([*table.values(), self.floor])
        self.sizes = np.array([*map(len, table)], np.int64)
        self.automaton = None

    def arcs(self, word: str) -> list[tuple[int, int, tuple[float, ...]]]:
        """(start, end, probabilities) of each piece in the word; single characters always have an arc."""
        get, out, n = self.table.get, [], len(word)
        for i in range(n):
            p = get(word[i])
            out.append((i, i + 1, p or self.floor))
            for j in range(i + 2, min(n, i + self.longest) + 1):
                p = get(word[i:j])
                if p:
                    out.append((i, j, p))
        return out

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, piece in enumerate(self.table):
            if "\n" not in piece:
                self.automaton.add_word(piece, k)
        self.automaton.make_automaton()

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Natural logarithm for each word and language, summed over all segmentations.

        All words go through the forward algorithm side by side: one automaton finds the pieces in them, and arcs are added
        start by start and size by size, of which each word has one at most.
        """
        if self.automaton is None:
            self.compile()
        parts = [START + w for w in words]
        text, sizes = "\n".join(parts), np.array([*map(len, parts)], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        last, piece = found[:, 0], found[:, 1]
        size = self.sizes[piece]
        alone = np.ones(len(text), bool)
        alone[last[size == 1]] = False
        alone[first[1:] - 1] = False
        lone = np.flatnonzero(alone)
        start, size, piece = np.r_[last + 1 - size, lone], np.r_[size, np.ones(len(lone), np.int64)], np.r_[piece, np.full(len(lone), len(self.table))]
        step = ((start - np.repeat(first, sizes + 1)[start]) * (self.longest + 1) + size)
        order = np.argsort(step, kind="stable")
        start, size, piece, step = start[order], size[order], piece[order], step[order]
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        sums = np.zeros((len(text) + 1, self.n))
        sums[first] = 1.0
        out, scaled = np.zeros((len(words), self.n)), RESCALE
        for low, high in zip(edges[:-1], edges[1:], strict=True):  # in the order of starts, so sums[start] is complete
            s = start[low:high]
            if step[low] >= scaled * (self.longest + 1):
                self.rescale(sums, first, sizes, scaled, out)
                scaled += RESCALE
            sums[s + size[low]] += sums[s] * self.rows[piece[low:high]]
        return out + np.log(sums[first + sizes])

    def rescale(self, sums: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: int, logs: np.ndarray) -> None:
        """Divides the sums from place ``at`` on, of words that reach it, by the greatest of them and adds its logarithm to ``logs``."""
        long = np.flatnonzero(sizes >= at)
        reach = np.minimum(sizes[long] - at, self.longest) + 1  # no arc has passed further
        owner, begin = np.repeat(np.arange(len(long)), reach), np.cumsum(reach) - reach
        place = np.arange(len(owner)) - begin[owner] + (first[long] + at)[owner]
        most = np.maximum.reduceat(sums[place], begin, axis=0)
        sums[place] /= most[owner]
        logs[long] += np.log(most)

    def expected(self, word: str, k: int) -> dict[str, float]:
        """Expected count of each piece in one language's segmentations of a word."""
        part, out = START + word, {}
        arcs = self.arcs(part)
        if len(part) > RESCALE:
            return self.expected_by_logarithms(part, arcs, k)
        ahead, back = [0.0] * (len(part) + 1), [0.0] * (len(part) + 1)
        ahead[0] = back[-1] = 1.0
        for i, j, p in arcs:
            ahead[j] += ahead[i] * p[k]
        for i, j, p in reversed(arcs):
            back[i] += p[k] * back[j]
        for i, j, p in arcs:
            if p is not self.floor:
                piece = part[i:j]
                out[piece] = out.get(piece, 0.0) + ahead[i] * p[k] * back[j] / ahead[-1]
        return out

    def expected_by_logarithms(self, part: str, arcs: list, k: int) -> dict[str, float]:
        out: dict[str, float] = {}
        ahead, back = [-math.inf] * (len(part) + 1), [-math.inf] * (len(part) + 1)
        ahead[0] = back[-1] = 0.0
        for i, j, p in arcs:
            ahead[j] = added(ahead[j], ahead[i] + math.log(p[k]))
        for i, j, p in reversed(arcs):
            back[i] = added(back[i], math.log(p[k]) + back[j])
        for i, j, p in arcs:
            if p is not self.floor:
                piece = part[i:j]
                out[piece] = out.get(piece, 0.0) + math.exp(ahead[i] + math.log(p[k]) + back[j] - ahead[-1])
        return out


def training_words(docs: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """Languages by code point, and (lang, word, n) over the sampled training documents."""
    rows = docs.filter(~held_out(F.col("doc_id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = dict(rows.groupBy("lang").count().collect())
    langs = sorted(counts)
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, sample / counts[x]))) for x in langs), F.lit(0.0)) if langs else F.lit(0.0)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in WORD.findall(text.lower()))
            if found:
                yield to_batch([(*k, n) for k, n in found.items()], schema)

    return langs, chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], dict[str, tuple[float, ...]]]:
    """(languages, piece -> probabilities). Bounded by the vocabulary times the languages."""
    langs, counted = training_words(docs, sample)
    n, pieces = len(langs), public_pieces(vocabulary)
    table = {p: (1.0 / len(pieces),) * n for p in pieces}
    if not n:
        return langs, table
    counted = Scratch(docs.sparkSession).table("training_words", counted).repartition(max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    schema = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("n", pa.float64())])
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, index, sums = Lattice(shared.value, n), {x: k for k, x in enumerate(langs)}, {}
            for b in batches:
                for lang, word, times in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    for piece, x in lattice.expected(word, index[lang]).items():
                        sums[lang, piece] = sums.get((lang, piece), 0.0) + times * x
            if sums:
                yield to_batch([(*k, x) for k, x in sums.items()], schema)

        expected = counted.mapInArrow(expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        got = {x: {} for x in langs}
        for lang, piece, x in expected:
            got[lang][piece] = x
        totals = {x: sum(v for _, v in sorted(got[x].items())) + 0.5 * len(pieces) for x in langs}
        table = {p: tuple((got[x].get(p, 0.0) + 0.5) / totals[x] for x in langs) for p in pieces}
    return langs, table


FIELDS = "doc_id long, held_out boolean, lang_pred string, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, langs: list[str], table: dict[str, tuple[float, ...]]) -> DataFrame:
    """Language and posterior probability (equal priors) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, index, vectors = Lattice(shared.value, len(langs)), {}, np.zeros((0, len(langs)))

        def judge(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal vectors
            found = [WORD.findall(t.lower()) if t and langs else [] for t in texts]
            if len(index) > CACHE_WORDS:
                index.clear()
                vectors = vectors[:0]
            fresh = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in index]
            if fresh:
                index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                vectors = np.concatenate([vectors, lattice.log_likelihoods(fresh)])
            out = []
            for own in found:
                if not any(c.isalpha() for w in own for c in w):
                    out.append(("und", 0.0))
                    continue
                total = vectors[[index[w] for w in own]].sum(axis=0)
                k = int(np.argmax(total))
                out.append((langs[k], round(1.0 / float(np.exp(total - total[k]).sum()), 6)))
            return out

        def judged(batch: pa.RecordBatch):
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column(2).to_pylist()
                yield from ((i, h, *x) for i, h, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), judge(texts), strict=True))

        return arrow_rows(batches, judged, SCHEMA)

    return rows.mapInArrow(run, FIELDS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, *fit(docs))
