"""Operator 1: line-first quality rules.

Every line of a text is judged by itself: a punctuation rule (symbols or exclamation runs crowd the words), a
navigation rule (separators split the line into menu-like pieces) and a boilerplate rule (fixed phrases of four
languages in a short line, or as a fifth of a longer one; a mention in running text fails nothing). Failing
lines are removed; a document whose removed lines held more than ``max_lost`` of its word characters is rejected.
The base rules (fewer than 50 words, or half of the words in repeated three-word windows) reject it as well.

Scale: one pass over the documents in Arrow batches, no shuffle, memory bounded by a batch.

Defined cases: null and empty texts have no words and fail; a text of blank lines likewise; repeated rows are judged
alike; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import arrow_rows, byte_texts, documents, text_rows

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MAX_LOST = 0.5
SYMBOLS = re.compile(rb"[#*$%&|<>]")
SYMBOL_BYTES = b"#*$%&|<>"
NAV_MARK = re.compile(rb"(?:^|\s)(?:[|/>]|\xc2\xbb|\xe2\x80\xba|\xe2\x80\xa2|\xc2\xb7)(?=\s|$)")
SHOUT = re.compile(rb"!{2,}")
SHORT, PHRASE_SHARE = 12, 5  # a phrase fails a line of up to 12 words, or of which phrases are at least a fifth
PHRASES = (  # English, German, French, Spanish
    r"all rights reserved|terms of (?:service|use)|privacy policy|cookie policy|accept (?:all )?cookies|"
    r"licensed under the|enable javascript|sign up for our newsletter|subscribe to our newsletter|"
    r"click here to|skip to (?:main )?content|copyright \(c\)|© ?(?:19|20)[0-9][0-9]",
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutz(?:erklärung|richtlinie)|cookie-richtlinie|cookies akzeptieren|"
    r"lizenziert unter de[rm]|javascript aktivieren|aktivieren sie (?:bitte )?javascript|newsletter (?:abonnieren|anmelden)|"
    r"klicken sie hier|zum (?:haupt)?inhalt springen",
    r"tous droits réservés|conditions (?:générales )?d(?:'|’)utilisation|politique de confidentialité|politique (?:en matière de|de|des|relative aux) cookies|"
    r"accepter (?:tous )?les cookies|distribué sous (?:la )?licence|active[rz] javascript|(?:inscrivez|abonnez)-vous à notre (?:newsletter|lettre)|"
    r"cliquez ici|aller au contenu",
    r"todos los derechos reservados|(?:términos|condiciones) de (?:servicio|uso)|política de (?:cookies|privacidad)|aceptar (?:todas )?las cookies|"
    r"bajo (?:la )?licencia|(?:active|habilite) javascript|suscríb(?:ase|ete) a nuestr[ao] (?:boletín|newsletter)|"
    r"ha(?:ga|z) clic aquí|(?:ir|saltar) al contenido",
)
#: Matches bytes whose A-Z are folded; other letters match in both cases.
BOILERPLATE = re.compile(re.sub(r"[à-ÿ]", lambda m: f"(?:{m[0]}|{m[0].upper()})", "|".join(PHRASES)).encode())


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether one of the line rules rejects a line of n_words words."""
    symbols = len(line) - len(line.translate(None, SYMBOL_BYTES))
    marks = len(NAV_MARK.findall(line)) if symbols or b"/" in line or not line.isascii() else 0
    if marks >= 2 and n_words - marks <= 4 * (marks + 1):  # navigation: pieces of four words at most
        return True
    if symbols - marks >= 3 and 2 * (symbols - marks) >= n_words:  # punctuation: a stray symbol for every two words
        return True
    if line.count(b"!!") >= 2 and 2 * len(SHOUT.findall(line)) >= n_words:
        return True
    phrases = sum(len(m.split()) for m in BOILERPLATE.findall(line.lower()))  # no group captures, so these are whole matches
    return phrases > 0 and (n_words <= SHORT or PHRASE_SHARE * phrases >= n_words)


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(tokens)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), np.int64, n)
    k = len(ids)
    pair = np.unique(seq[:-1] * k + seq[1:], return_inverse=True)[1]
    window, counts = np.unique(pair[:-1] * k + seq[2:], return_inverse=True, return_counts=True)[1:]
    hit = counts[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def judge(raw: bytes, max_lost: float) -> tuple:
    """Measures and verdict of one text, with the text that remains of it."""
    tokens = raw.split()
    n_words = len(tokens)
    seen: set[bytes] = set()
    n_dup = lost = n_failed = 0
    stay = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            stay.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        if line_fails(line, len(own)):
            n_failed += 1
            lost += code_points(b"".join(own))
        else:
            stay.append(line)
    chars = code_points(b"".join(tokens))
    repeats = repeated_words(tokens)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n_words
    kept = not base_failed and lost <= max_lost * chars
    symbols = len(raw) - len(raw.translate(None, SYMBOL_BYTES))
    return n_words, chars, symbols, n_dup, repeats, base_failed, kept, n_failed, lost, b"\n".join(stay).decode() if kept and n_failed else None


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode())


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long, cleaned string"
SCHEMA = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_failed_lines", pa.int64()), ("lost_chars", pa.int64()), ("cleaned", pa.string())])


def assess(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per document: measures, verdict, and ``cleaned`` where a kept document lost lines (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(batches, lambda b: ((i, *judge(t, max_lost)) for i, t in zip(b.column(0).to_pylist(), byte_texts(b), strict=True)), SCHEMA, 2000)

    return text_rows(docs).mapInArrow(run, FIELDS)


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept rows of docs, all columns, with failing lines removed from ``text``. One pass, no join."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t, max_lost) for t in byte_texts(batch)]
            texts = [v[9] if v[9] is not None else t for v, t in zip(verdicts, batch.column(at).to_pylist(), strict=True)]
            full = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield full.filter(pa.array([v[6] for v in verdicts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir)).drop("n_failed_lines", "lost_chars", "cleaned")
