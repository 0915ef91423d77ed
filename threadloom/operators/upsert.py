"""Idempotent upserts on snapshots: a table and a batch in, the next table out.

Each is one equi-join on the key, so both sides shuffle once on it; a table bucketed by its key does not shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in ``order``. Partial aggregation on the map side, no sort of the rows of a key."""
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(x) if isinstance(x, str) else x for x in order]
    last = F.max_by(F.struct(*rest), F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order))))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*(F.col(k) if k in keys else F.col(f"_last.{k}") for k in rows.columns))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows a deduplication on the keys drops."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), coalesced: Sequence[str] = ()) -> DataFrame:
    """The table after the batch, whose rows replace those of equal key, nulls included.

    ``keep``: columns that stay as stored on replacement and are null in new rows. ``coalesced``: columns in which a null of the
    batch leaves the stored value. The batch holds one row for each key (see last_per_key).
    """
    old, new = table.alias("old"), batch.withColumn("_new", F.lit(True)).alias("new")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    fresh = F.col("new._new").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            value = F.coalesce(f"new.{c}", f"old.{c}")
        elif c in keep:
            value = F.col(f"old.{c}")
        elif c in coalesced:
            value = F.coalesce(f"new.{c}", f"old.{c}")
        else:
            value = F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        return value.alias(c)

    return old.join(new, on, "full_outer").select(*map(column, table.columns))


def upsert_items(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Incoming columns win, null or not, but lineage once known is never erased."""
    return upsert(table, batch, ["id"], coalesced=["story_id"])


def upsert_items_legacy(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The realtime path: lineage is not written at all."""
    return upsert(table, batch, ["id"], keep=["story_id"])


def check_batch(items: DataFrame, kids: DataFrame) -> bool:
    """Whether there is anything to write. Edges without items break an invariant."""
    if not items.isEmpty():
        return True
    if not kids.isEmpty():
        raise ValueError("a batch has edges but no items")
    return False


def changed(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the batch that are new or differ from the stored row in any column; two nulls do not differ."""
    old = table.select(*(F.col(c).alias(f"_{c}") for c in batch.columns), F.lit(True).alias("_old"))
    on, differs = F.lit(True), F.col("_old").isNull()
    for c in batch.columns:
        if c in keys:
            on = on & (F.col(c) == F.col(f"_{c}"))
        else:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return batch.join(old, on, "left").filter(differs).select(*batch.columns)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with new rows, whose keys it does not hold; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def update_from(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: rows that meet a change take its values, others stay."""
    changed = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = table.join(changed, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def cascade_delete(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return children.join(removed.select(key), key, "left_anti")


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a constraint, with the names of those they break. A null result breaks nothing, as in SQL."""
    broken = F.array_compact(F.array(*(F.when(~check, F.lit(name)) for name, check in checks.items())))
    return rows.withColumn("violated", broken).filter(F.size("violated") > 0)
