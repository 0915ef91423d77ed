"""Root stories of comments by pointer jumping.

Each unresolved comment points at an ancestor; a round replaces the pointer by its target's pointer, or takes the target's
story. Depth halves each round, so a chain of 1000 replies needs ten joins and not a thousand. Rounds end when nothing is
left to follow; state is cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import Scratch


def parent_refs(batch: DataFrame, items: DataFrame) -> DataFrame:
    """(id, type, story_id) of the stored parents of a batch: three columns of the rows that are asked for."""
    wanted = batch.filter("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    return items.select("id", "type", "story_id").join(wanted, "id", "left_semi")


def _follow(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) from ``nodes(id, label, pointer)``: label of the first labelled node along the pointers, or null.

    Each round writes the labels it finds and the pointers that go on, and drops the pointers before. After a round in which none of those left
    found a label or an end, and with at least as many steps taken as nodes were open at first, only cycles are left.
    """
    done = scratch.table("labelled", nodes.filter("label IS NOT NULL").select("id", "label"))
    open_, k = scratch.table("open0", nodes.filter("label IS NULL AND pointer IS NOT NULL").select("id", "pointer")), 0
    left = first = open_.count()
    while left:
        found = open_.join(done.select(F.col("id").alias("pointer"), "label"), "pointer", "left")
        onward = open_.select(F.col("id").alias("pointer"), F.col("pointer").alias("next"))
        state = scratch.table(f"round{k}", found.join(onward, "pointer", "left").select("id", "label", "next"))
        done = done.unionByName(scratch.table(f"done{k}", state.filter("label IS NOT NULL").select("id", "label")))
        open_ = scratch.table(f"open{k + 1}", state.filter("label IS NULL AND next IS NOT NULL AND next <> id").select("id", F.col("next").alias("pointer")))
        scratch.drop(f"open{k}", f"round{k}")
        k, before, left = k + 1, left, open_.count()
        if left == before and 2**k > first:  # pointers that have gone further than any chain is long go round in a cycle
            break
    return done


def backfill(items: DataFrame) -> DataFrame:
    """Items with ``story_id`` filled as far as parents allow: stories get their own id, comments their parent's story."""
    own = F.when((F.col("type") == "story") & F.col("story_id").isNull(), F.col("id")).otherwise(F.col("story_id"))
    nodes = items.select("id", own.alias("label"), F.when(F.col("type") == "comment", F.col("parent")).alias("pointer"))
    labels = _follow(nodes, Scratch(items.sparkSession)).withColumnRenamed("id", "_id")
    joined = items.join(labels, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("story_id", F.coalesce("story_id", "label")).drop("_id", "label")


def seed_stories(items: DataFrame) -> DataFrame:
    """Stories whose lineage is null get their own id."""
    return items.withColumn("story_id", F.when((F.col("type") == "story") & F.col("story_id").isNull(), F.col("id")).otherwise(F.col("story_id")))


def changed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (n_changed): how many rows of a table an update changed, by (id, story_id) before and after it."""
    both = before.select("id", F.col("story_id").alias("_before")).join(after.select("id", "story_id"), "id")
    return both.agg(F.count_if(~F.col("_before").eqNullSafe(F.col("story_id"))).alias("n_changed"))


def backfill_batch(items: DataFrame, limit: int) -> DataFrame:
    """(id, story_id) of one pass: the first ``limit`` unresolved comments by id whose parent is resolved or a story."""
    c, p = items.alias("c"), items.alias("p")
    ready = c.join(p, F.col("p.id") == F.col("c.parent")).filter((F.col("c.type") == "comment") & F.col("c.story_id").isNull() & (F.col("p.story_id").isNotNull() | (F.col("p.type") == "story")))
    return ready.select(F.col("c.id").alias("id"), F.coalesce("p.story_id", "c.parent").alias("story_id")).orderBy("id").limit(limit)


def unresolved_comments(items: DataFrame) -> DataFrame:
    return items.filter((F.col("type") == "comment") & F.col("story_id").isNull()).agg(F.count(F.lit(1)).alias("n_unresolved"))


def resolve(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch's rows with lineage resolved within it, stored parents helping one level.

    Rows of the batch hide stored rows of equal id. Types other than story and comment lose their lineage.
    A story parent gives its id; a comment under an unresolved stored row stays null for the backfill.
    """
    label = F.when(F.col("type") == "story", F.col("id")).when(F.col("type") == "comment", F.col("story_id"))
    own = batch.select("id", label.alias("label"), F.when(F.col("type") == "comment", F.col("parent")).alias("pointer"))
    refs = parent_refs(batch, stored).join(batch.select("id"), "id", "left_anti")
    known = refs.select("id", F.when(F.col("type") == "story", F.col("id")).otherwise(F.col("story_id")).alias("label"), F.lit(None).cast("long").alias("pointer"))
    labels = _follow(own.unionByName(known), Scratch(batch.sparkSession)).withColumnRenamed("id", "_id")
    joined = batch.join(labels, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("story_id", F.col("label")).drop("_id", "label")
