"""Global order without a single task: range sort, then numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import Scratch

#: monotonically_increasing_id puts the partition above this many bits, and the row's place in it below.
BITS = 33


def numbered(df: DataFrame, order: list[str | Column], column: str, scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``column``: 0, 1, 2, ... in the order of ``order``, whose last key should be unique, so that any run of equal keys can be split.

    The sort spreads rows by sampled ranges, whatever their keys. The driver sees one count for each partition.
    """
    order = [F.col(x) if isinstance(x, str) else x for x in order]
    placed = scratch.table(name, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for k, n in counts:
        offsets.append((k, before))
        before += n
    known = placed.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = placed.join(F.broadcast(known), part == F.col("_part"))
    return joined.withColumn(column, F.col("_before") + F.col(column).bitwiseAND((1 << BITS) - 1)).drop("_part", "_before")
