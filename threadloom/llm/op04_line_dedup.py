"""Operator 4: line dedup by overlapping three-line windows. DataFrame functions only.

Lines are a text's \n-split lines, trimmed of ASCII white space for comparison; blank lines take no part and always
stay. A window is three consecutive lines that are not blank, a document's k-th window beginning at its k-th such
line. Windows are compared by two 64-bit hashes of the three lines. A document is a row, known by its doc_id and a hash of its text. A window is repeated if an equal
one begins earlier: in a smaller doc_id, in a text of the same doc_id with a smaller hash, or earlier in the same document. Every line that a repeated window covers is removed, windows being judged on the input. The first
occurrence stays, so a passage of three or more lines is left once.

Scale: only window hashes and places are shuffled to find repeats, the count and the first place per hash being
combined on the map side; places of hashes seen once never go further. Hashes that hold a ``HOT``-th of all windows or more are ``HOT`` at most, so
they are broadcast and meet their windows where those are; the join of all others has no key above that share. Covered places are merged per document.

Defined cases: null text gives n_lines 0 and stays null; fewer than three lines are never removed; rows that share a doc_id
are documents of their own if their texts differ, while copies of a row count as one document and each gets its result;
rows without a doc_id come before all others;
an empty table gives an empty result; extra columns pass through ``dedup_lines``, whose n_lines and n_removed take the place of
columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, documents

WINDOW = 3
HOT = 2000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\f"))


def _blank(line: Column) -> Column:
    return _trimmed(line) == ""


def _solid(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _trimmed), lambda x: x != "")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, covered): sorted indexes, among lines that are not blank, which repeated windows cover in the text of that hash."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("hash"), _solid(F.col("text")).alias("lines")).filter(F.size("lines") >= WINDOW)
    at = lambda i, j: F.get(F.col("lines"), i + j)
    keys = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.struct(F.xxhash64(*(at(i, j) for j in range(WINDOW))).alias("h"), F.xxhash64(F.lit("second"), *(at(i, j) for j in range(WINDOW))).alias("g"), i.cast("int").alias("line")),
    )
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table("windows", lines.select("doc_id", "hash", F.inline(keys)))
    place = F.struct("doc_id", "hash", "line")  # a null orders first, in min and in the comparison below
    first = scratch.table("first", windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = first.filter(F.col("n") * HOT >= windows.count())
    later = windows.join(F.broadcast(hot), ["h", "g"]).unionByName(windows.join(F.broadcast(hot), ["h", "g"], "left_anti").join(first, ["h", "g"]))
    later = later.filter(place > F.col("first")).select("doc_id", "hash", "line")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_list("line"), lambda i: F.sequence(i, i + WINDOW - 1)))))
    return later.groupBy("doc_id", "hash").agg(covered.alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated lines taken from ``text``, and n_lines and n_removed (of lines not blank)."""
    cut = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    whole, raw = docs.select(F.struct(*docs.columns).alias("row")), F.col("raw")  # one name, so that no other column's can clash
    # Hashing the cuts, a few numbers a document, spares a sort of whole texts.
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("hash"))
    joined = whole.join(cut.hint("shuffle_hash"), same, "left").select("row", "covered", F.split(F.col("row.text"), "\n", -1).alias("raw"))
    # Places of the lines that are not blank, then what remains of all places: linear in the lines of a text.
    marked = F.transform(raw, lambda x, i: F.when(~_blank(x), i))
    joined = joined.withColumn("places", F.when(F.col("covered").isNotNull(), F.filter(marked, lambda i: i.isNotNull())))
    gone = F.transform("covered", lambda k: F.get(F.col("places"), k))
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), gone)
    text = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(raw, i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(raw, lambda x: ~_blank(x))), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    others = (F.col(f"row.{c}") if c != "text" else text.alias("text") for c in docs.columns if c not in ("n_lines", "n_removed"))
    return joined.select(*others, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
marked AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM raw),
solid AS (SELECT doc_id, nth, t, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS k FROM marked WHERE t <> ''),
win AS (
  SELECT doc_id, k, t || chr(10) || lead(t) OVER w || chr(10) || lead(t, 2) OVER w AS body FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS r FROM win WHERE body IS NOT NULL),
gone AS (SELECT DISTINCT l.doc_id, l.k + o AS k FROM later l, (SELECT unnest([0, 1, 2]) AS o) WHERE r > 1),
gone_nth AS (SELECT s.doc_id, s.nth FROM solid s JOIN gone USING (doc_id, k)),
kept AS (
  SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.nth) AS kept FROM marked m ANTI JOIN gone_nth g ON m.doc_id = g.doc_id AND m.nth = g.nth GROUP BY m.doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM solid GROUP BY doc_id),
cuts AS (SELECT doc_id, count(*) AS n_removed FROM gone_nth GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN cuts x USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
