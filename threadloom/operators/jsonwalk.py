"""Walks over JSON texts of any depth, level by level, in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import Scratch


def json_strings(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """(keys..., path, value): each string anywhere in the JSON texts ``raw``, by paths such as ``$.a[0].b``. Malformed and null texts give none.

    A round takes every container that is left apart into its values; rounds end when none is left, so their number is the depth of the deepest text and each one
    handles only what is that deep.
    """
    scratch, level, found = Scratch(rows.sparkSession), rows.select(*keys, F.lit("$").alias("path"), F.try_parse_json(raw).alias("v")).filter("v IS NOT NULL"), []
    names = ", ".join(f"c.`{k}`" for k in keys)
    while True:
        level = scratch.table(f"level{len(found)}", level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)))
        found.append(level.filter("kind = 'STRING'").select(*keys, "path", F.col("v").cast("string").alias("value")))
        containers = level.filter("kind IN ('ARRAY', 'OBJECT')")
        if containers.isEmpty():
            return reduce(DataFrame.unionByName, found)
        step = "CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END"
        level = rows.sparkSession.sql(f"SELECT {names}, concat(c.path, {step}) AS path, e.value AS v FROM {{containers}} c, LATERAL variant_explode(c.v) e", containers=containers)
