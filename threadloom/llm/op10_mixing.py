"""Operator 10: mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: linear, ``weight * (1 + slope * (2t - 1))``. Its
integral is the source's weight, which fixes the source's share of all tokens; the normalised integral
``(1 - slope) * t + slope * t^2`` is the fraction of the source's tokens demanded by time t. A document at cumulative
token y of its source's demand is assigned the t at which demand reaches y, by inverting that quadratic. Range-sorting
documents by t yields the training order, in which the query returns them, with documents of which nothing is taken at the end.

Targets stop at ``max_epochs`` times a source's size; the excess is reshared by weight until none is above.
Documents queue in the order of md5(doc_id), so reruns agree and the order owes nothing to the input's layout. A
document takes ``round(ratio * end) - round(ratio * start)`` words of its span [start, end) in the queue: whole passes
and, at most once, a part of one. So taken words add up to the rounded target and never exceed max_epochs * size.

Scale: sizes reduce to one row per source for the targets. Queues come from one range sort of short rows (no texts), whose last key is unique, so a source with a third of
all rows, and a doc_id with as many, are spread over tasks. Prefix sums are two-level: sums per (source, task of the sort) first, then sums inside each.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, the last in
order; repeated doc_id rows each stay and are queued one after another (by size, then by a hash of their columns); rows without a doc_id queue by a hash of their text; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, documents, words

SLOPES = (0.5, 0.0, -0.5)  # of sources 1, 2, 3, repeating: late, level, early


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares by weight, capped, the excess reshared.

    One small aggregate per round; a round only ever adds capped sources, so it ends, and usually within five.
    """
    cap = F.col("source_size") * max_epochs
    rate = None
    while True:
        full = F.lit(False) if rate is None else cap <= F.col("weight") * F.lit(rate)
        total, capped, open_weight = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        after = (total - capped) / open_weight if open_weight else 0.0
        if after == rate or not open_weight:
            return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(rate or 0.0))))
        rate = after


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), slopes: tuple[float, ...] = SLOPES, max_epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position (null if nothing is taken), row (a hash of its columns)."""
    row, scratch = F.xxhash64(*docs.columns), Scratch(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), row.alias("row"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")).alias("order_key"), F.monotonically_increasing_id().alias("nth"))
    order, sized = ("source", "order_key", "size", "row", "nth"), scratch.table("sized", sized)  # once, as the sort reads its input twice
    queue = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("order_key", "nth")
    queue = scratch.table("queue", queue.withColumn("task", F.shiftright("at", 33)))
    sums = scratch.table("sums", queue.groupBy("source", "task").agg(F.sum("size").alias("task_size")))

    # One row per source: the ranking below handles the table of sources, not the documents.
    ranked = sums.groupBy("source").agg(F.sum("task_size").alias("source_size")).withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("nth") % len(values) + 1).cast("int"))
    sources = water_fill(scratch.table("sources", ranked.withColumns({"weight": pick(weights), "slope": pick(slopes)})), max_epochs)

    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "task", F.coalesce(F.sum("task_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "o.task", "offset", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "task").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    queued = queue.withColumn("end_in_task", F.sum("size").over(inside)).alias("d")
    joined = queued.join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.task") == F.col("o.task")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.col("offset") + F.col("end_in_task")
    reached = lambda at: F.floor(ratio * at + 0.5)
    y = (ratio * (end - F.col("size"))) / F.col("target")
    b = 1 - F.col("slope")
    time = F.when(F.col("slope") == 0, y).otherwise((F.sqrt(b * b + 4 * F.col("slope") * y) - b) / (2 * F.col("slope")))
    taken = (reached(end) - reached(end - F.col("size"))).cast("long")
    return joined.select("doc_id", "d.source", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, time).alias("position"), "row")


def training_order(mixed: DataFrame) -> DataFrame:
    """Documents that are taken, range-sorted by their training position."""
    return mixed.filter("taken > 0").orderBy("position", "doc_id")


def all_in_order(mixed: DataFrame) -> DataFrame:
    """Every document: those that are taken in training order, the others after them."""
    # A position is not null exactly where something is taken. The others are spread by doc_id, so no task gets them all.
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs in training order with size, source_size, target, taken and position, which take the place of columns so named."""
    added = ("size", "source_size", "target", "taken", "position")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(0)))  # of rows that are equal throughout
    places = mix(docs, **parameters).select("row", *added).withColumn("nth", nth)
    whole = docs.select(F.struct(*docs.columns).alias("document"), F.xxhash64(*docs.columns).alias("row")).withColumn("nth", nth)
    joined = whole.join(places, ["row", "nth"])
    return all_in_order(joined.withColumn("doc_id", F.col("document.doc_id"))).select(*(F.col(f"document.{c}") for c in docs.columns if c not in added), *added)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in training order."""
    return all_in_order(mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight,
    CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE -0.5 END AS DOUBLE) AS slope FROM sized GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY 3.0 * source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM ranked),
rate AS (
  SELECT CAST(total - capped_before AS DOUBLE) / CAST(open_weight AS DOUBLE) AS r FROM levels
  WHERE 3 * source_size * open_weight > weight * (total - capped_before) ORDER BY 3.0 * source_size / weight LIMIT 1),
targets AS (SELECT source, source_size, slope, least(CAST(3 * source_size AS DOUBLE), weight * coalesce((SELECT r FROM rate), 0)) AS target FROM ranked),
queued AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS e FROM sized),
rated AS (
  SELECT q.*, t.source_size, t.target, t.slope, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio
  FROM queued q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, CAST(floor(ratio * CAST(e AS DOUBLE) + 0.5) - floor(ratio * CAST(e - size AS DOUBLE) + 0.5) AS BIGINT) AS taken,
    ratio * CAST(e - size AS DOUBLE) / target AS y, 1 - slope AS b, CAST(4 AS DOUBLE) * slope AS s FROM rated)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN y ELSE (sqrt(b * b + s * y) - b) / (CAST(2 AS DOUBLE) * slope) END END AS position FROM placed
"""
