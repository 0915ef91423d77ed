"""Operator 5: secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold: literal runs give
conjunctions, alternatives give disjunctions, everything else gives no condition. Each block of documents (an Arrow batch)
is indexed in one pass over its bytes by the trigrams that some query names: one posting bitmap per trigram. A rule's candidates are its
query evaluated by intersecting and uniting postings; only those are verified with the expression itself. A rule
whose query has no mandatory trigram scans every document of the block.

Base kinds are assign, access and hex. The method adds private key blocks and the public token formats of ``EXTRA_RULES``.

Scale: one pass, no shuffle. Postings live as long as a block, so memory is bounded by the batch size and the index
needs no global table. Spans count code points, end exclusive.

Defined cases: null texts are empty and have no spans; repeated rows are scanned each; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import arrow_rows, documents, text_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Whether letters match in either case; its trigrams are looked up in the lower-cased text.
    either_case: bool = False
    accept: Callable[[re.Match], bool] = bool


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", accept=lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", accept=lambda m: len(m[0]) >= 24),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES
#: What the whole-text scan for hex looks for first; equal in spans to the rule with its length check.
PIECE = 1 << 20  # bytes that are looked at together
PREFILTER = {"hex": re.compile("[0-9a-f]{24}")}


# A query is True (no condition), a trigram, ("and", ...) or ("or", ...).
def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> object:
    return True if True in parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _runs(tree) -> list[tuple[bool, object]]:
    """A parsed sequence as (is literal text, text or query) parts, in order."""
    out: list[tuple[bool, object]] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append((True, chr(arg)))
        elif op is sre.SUBPATTERN:
            inner = _runs(arg[3])
            out.extend(inner)
        elif op is sre.BRANCH:
            out.append((False, _any([trigrams(x) for x in arg[1]])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            out.append((False, trigrams(arg[2])))
        else:  # classes, optional parts, anchors: no condition, and literals on either side don't touch
            out.append((False, True))
    return out


def trigrams(tree) -> object:
    """The Boolean trigram query that each match of a parsed expression satisfies."""
    parts, run = [], ""
    for literal, x in [*_runs(tree), (False, True)]:
        if literal:
            run += x
        else:
            parts += [run[i : i + 3] for i in range(len(run) - 2)]
            parts.append(x)
            run = ""
    return _all(parts)


def query_of(rule: Rule) -> object:
    return trigrams(sre_parser.parse(rule.pattern))


def named_in(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named_in, query[1:]))


def candidates(query: object, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.ones(n, bool)
    if isinstance(query, str):
        return postings[query]
    parts = [candidates(q, postings, n) for q in query[1:]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def post(texts: pa.Array, names: set[str]) -> dict[str, np.ndarray]:
    """The block's index: for each trigram, a bitmap of the rows that hold it. One pass over the block's bytes, however many trigrams there are."""
    order = sorted(names)
    postings = np.zeros((len(order), len(texts)), bool)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    number = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(order):
        number[int.from_bytes(t.encode(), "big")] = k + 1
    for at in range(0, len(data) - 2, PIECE):
        own = data[at : at + PIECE + 2].astype(np.uint32)
        named = number[own[:-2] << 16 | own[1:-1] << 8 | own[2:]]
        found = np.flatnonzero(named)
        row = np.searchsorted(offsets, found + at, "right") - 1
        inside = found + at + 3 <= offsets[row + 1]  # and not over the end of a text
        postings[named[found[inside]] - 1, row[inside]] = True
    return dict(zip(order, postings, strict=True))


def scan_block(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text: (kind, start, end), by rule, then start."""
    n, queries = len(texts), [query_of(r) for r in rules]
    lower = pc.ascii_lower(texts)
    named = {True: set(), False: set()}
    for r, q in zip(rules, queries, strict=True):
        named[r.either_case] |= named_in(q)
    postings = {True: post(lower, named[True]), False: post(texts, named[False])}
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    values = texts.to_pylist()
    for r, q in zip(rules, queries, strict=True):
        rx = re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.either_case else 0))
        first = PREFILTER.get(r.kind)
        for i in np.flatnonzero(candidates(q, postings[r.either_case], n)):
            if first and not first.search(values[i]):
                continue
            found[i] += [(r.kind, m.start(), m.end()) for m in rx.finditer(values[i]) if r.accept(m)]
    return found


FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{r.kind}", pa.int64()) for r in BASE_RULES), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans by start, then by rule."""
    order = {r.kind: i for i, r in enumerate(rules)}
    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def rows(batch: pa.RecordBatch):
        texts = batch.column(1)
        for i, spans in zip(batch.column(0).to_pylist(), scan_block(texts, rules), strict=True):
            spans = sorted(spans, key=lambda x: (x[1], order[x[0]], x[2]))
            own = [x for x in spans if x[0] in base]
            counts = [sum(k == x[0] for x in own) for k in base]
            yield i, *counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)

    return text_rows(docs).mapInArrow(lambda batches: arrow_rows(batches, rows, SCHEMA), FIELDS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
