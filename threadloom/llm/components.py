"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; a component's id is its smallest node.

    Each round hangs a node's neighbours on its smallest neighbour; rounds grow with the logarithm of a component's
    diameter. State lives in written tables. Roots are written before edges are joined with them, so that a hub's edges meet one row of a plain join, which AQE
    can split. The driver sees two numbers a round.
    """
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    state, mark, k = scratch.table("edges0", tidy(edges)), None, 0
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = scratch.table(f"root{k}", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
        large = both.join(root, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        wide = scratch.table(f"large{k}", tidy(large))
        small_root = scratch.table(f"small{k}", wide.groupBy("b").agg(F.min("a").alias("root")))
        small = wide.join(small_root, "b").select(F.col("a").alias("x"), F.col("b").alias("y"), "root")
        small = small.select(F.col("x").alias("a"), F.col("root").alias("b")).unionByName(small.select(F.col("y").alias("a"), F.col("root").alias("b")))
        after = scratch.table(f"edges{k + 1}", tidy(small))
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges{k}", f"root{k}", f"large{k}", f"small{k}")
        if now == mark:
            break
        state, mark, k = after, now, k + 1
    return after.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
