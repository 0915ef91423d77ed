"""Operator 6: benchmark decontamination by winnowing. DataFrame functions only.

A benchmark window is 13 consecutive words of an item, or all words of a shorter one. Documents are winnowed: of each
``KEEP`` = 9 consecutive 5-gram hashes the smallest is kept (the leftmost of equals). 9 + 5 - 1 = 13, so each 13-word
span keeps at least one 5-gram, and since the choice depends on those words alone, a document's copy of a benchmark
window keeps the 5-gram that the window itself would choose. Documents and windows are joined on that fingerprint; each hit is extended to the whole window
and compared word for word. So every shared window is found and no other one.

Items of fewer than 13 words have no such guarantee; for each of their lengths that occurs, documents give all grams of
min(length, 5) words instead, joined on the window's first gram.

Scale: documents send (hash, doc_id, place) of about a fifth of their words. The benchmark side is broadcast if it has
at most ``BROADCAST_WINDOWS`` windows, which is counted first; beyond that the join shuffles. Only hits, one array
per document, go back to the texts. A text is split again there instead of its words being carried through the join.

Defined cases: null texts and texts without words have no words, hits or items and are not contaminated; null items
are none; items with equal text each count; without benchmark rows
nothing is hit; an empty documents table gives an empty result; other columns pass through ``decontaminate``. Each row is judged by its own text, whatever doc_id it
has, shares or lacks: rows are known by two hashes of doc_id and text, and copies of a row get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, documents

SPAN, GRAM = 13, 5
KEEP = SPAN - GRAM + 1
BROADCAST_WINDOWS = 200_000
KEY = ("row1", "row2")
#: The complement of the contract's word class, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def item_words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, other letters as they are. lower() is exact where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def gram_hash(words: Column, at: Column, k: int) -> Column:
    """32 bits of the hash of k words. Equal grams have equal ones; what meets by chance fails the comparison."""
    return F.shiftright(F.xxhash64(F.lit(k), *(F.get(words, at + j) for j in range(k))), 32)


def placed_hashes(words: Column, last: Column) -> Column:
    """Of each 5-gram, hash and place in one number whose order is that of the hash, then of the place."""
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(gram_hash(words, i, GRAM), 32).bitwiseOR(i.cast("long")))


def place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): each distinct window of each item."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SPAN, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, SPAN))
    return items.select("item_id", F.explode(F.array_distinct(spans)).alias("words"))


def keyed_windows(distinct: DataFrame) -> DataFrame:
    """(h, k, at, words): the gram by which a window is looked up, its length, and its place in the window."""
    least = F.array_min(placed_hashes(F.col("words"), F.lit(SPAN - GRAM)))
    long = distinct.filter(F.size("words") == SPAN).withColumn("least", least)
    long = long.select(F.shiftright("least", 32).alias("h"), F.lit(0).alias("k"), place(F.col("least")).alias("at"), "words", "window")
    short = distinct.filter(F.size("words") < SPAN)
    first = F.coalesce(*(F.when(F.size("words") >= k, gram_hash(F.col("words"), F.lit(0), k)) for k in range(GRAM, 0, -1)))
    return long.unionByName(short.select(first.alias("h"), F.least(F.size("words"), F.lit(GRAM)).alias("k"), F.lit(0).alias("at"), "words", "window"))


def every_gram(k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(gram_hash(F.col("w"), i, k).alias("h"), i.alias("place")))


def row_key() -> list[Column]:
    """Two hashes that tell rows apart by doc_id and text. A null is not hashed, so a mark stands for it."""
    parts = (F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text"))
    return [F.xxhash64(*parts).alias(KEY[0]), F.xxhash64(F.lit("second"), *parts).alias(KEY[1])]


def document_grams(texts: DataFrame, short: list[int]) -> DataFrame:
    """(row1, row2, h, k, place): winnowed 5-grams (k = 0), and all k-grams for each k in ``short``."""
    split = texts.select(*KEY, item_words(F.col("text")).alias("w"))
    hashed = split.filter(F.size("w") >= SPAN).select(*KEY, placed_hashes(F.col("w"), F.size("w") - GRAM).alias("g"))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("g") - KEEP + 1), lambda i: F.array_min(F.slice(F.col("g"), i, KEEP))))
    kept = hashed.select(*KEY, F.explode(chosen).alias("m"))
    grams = kept.select(*KEY, F.shiftright("m", 32).alias("h"), F.lit(0).alias("k"), place(F.col("m")).alias("place"))
    for k in short:
        grams = grams.unionByName(split.filter(F.size("w") >= k).select(*KEY, F.inline(every_gram(k))).select(*KEY, "h", F.lit(k).alias("k"), "place"))
    return grams


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row1, row2, n_hit, items): rows with benchmark windows, the words hit, and the sorted ids of the items."""
    scratch = Scratch(docs.sparkSession)
    of_item = scratch.table("windows", windows(benchmark).select("item_id", "words", F.struct(F.xxhash64("words", F.lit(1)).alias("w1"), F.xxhash64("words", F.lit(2)).alias("w2")).alias("window")))
    keyed = scratch.table("keyed", keyed_windows(of_item.select("words", "window").distinct()))
    n_windows, short = keyed.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("k"))).first()
    side = F.broadcast(keyed) if n_windows <= BROADCAST_WINDOWS else keyed

    texts = docs.select(*row_key(), "text")
    found = document_grams(texts, [k for k in short if k]).join(side, ["h", "k"]).filter(F.col("place") >= F.col("at"))
    hits = scratch.table("hits", found.select(*KEY, F.struct((F.col("place") - F.col("at")).alias("start"), "words", "window").alias("hit")))
    per_doc = hits.groupBy(*KEY).agg(F.collect_set("hit").alias("hits"))
    compared = texts.join(per_doc, list(KEY)).select(*KEY, "hits", item_words(F.col("text")).alias("w"))
    same = F.filter("hits", lambda x: (x["start"] + F.size(x["words"]) <= F.size("w")) & (F.slice(F.col("w"), x["start"] + 1, F.size(x["words"])) == x["words"]))
    true = scratch.table("true", compared.select(*KEY, F.inline(same)).select(*KEY, "start", F.size("words").alias("n"), "window"))
    covered = true.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    covered = covered.select(*KEY, F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long").alias("n_hit"))
    items = true.select(*KEY, "window").distinct().join(of_item.select("item_id", "window"), "window")
    items = items.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return scratch.table("contamination", covered.join(items, list(KEY)))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def with_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs (row1, row2, ...) with ``found``'s columns, zero or empty where it has no row."""
    joined = docs.join(found, list(KEY), "left")
    return joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    sizes = texts.select(*row_key(), F.size(item_words(F.col("text"))).alias("n_words"))
    hit = contamination(texts, benchmark).join(sizes, list(KEY)).filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
    keyed = docs.select(*row_key(), F.struct(*docs.columns).alias("columns"))
    return keyed.join(hit.select(*KEY).distinct(), list(KEY), "left_anti").select(*(F.col(f"columns.{c}") for c in docs.columns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.col("n_hit")
    return with_hits(sizes, found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS body FROM starts),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON win.n = p.n AND win.body = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
