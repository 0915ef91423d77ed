"""Decoding of upstream item payloads, and the file-backed item source with scripted response statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, VariantType

from threadloom.functions import text
from threadloom.sources.schemas import PAYLOAD

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


def tolerant_bool(payload: Column, field: str, depth: int = 4) -> Column:
    """A boolean that upstream sends in many shapes: itself, a number (not 0), a word, or an array's first element."""
    return variant_bool(F.try_parse_json(payload), f"$.{field}", depth)


def variant_bool(value: Column, at: str = "$", depth: int = 4) -> Column:
    """The same of a parsed value at a path. A column is parsed once for all uses; an expression is parsed at each."""
    out = F.lit(None).cast("boolean")
    for k in reversed(range(depth + 1)):
        here = F.try_variant_get(value, at + "[0]" * k, "variant")
        kind = F.schema_of_variant(here)
        word = F.lower(F.trim(F.try_variant_get(value, at + "[0]" * k, "string")))
        number = F.try_variant_get(value, at + "[0]" * k, "double")
        flat = F.when(kind == "BOOLEAN", F.try_variant_get(value, at + "[0]" * k, "boolean")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number != 0)
        flat = flat.when((kind == "STRING") & word.isin(*TRUE_WORDS), True).when((kind == "STRING") & word.isin(*FALSE_WORDS), False)
        out = flat.when(kind.startswith("ARRAY"), out)
    return out


FLAGS = ("deleted", "dead")


def decode_items(raw: DataFrame, payload: str = "payload", only: tuple[str, ...] = (*FLAGS, *PAYLOAD.names)) -> DataFrame:
    """Adds ``item`` (struct of the fields in ``only``, null if the payload is rejected) and ``failure_class``.

    Unknown fields are dropped and absent ones null. A field of the wrong type rejects the whole item, as does a missing id; unparseable
    text is of class decode. A payload of JSON null is a missing item: neither item nor failure.
    """
    flags = [StructField(n, VariantType()) for n in FLAGS if n in only]  # parsed in the same pass, whatever their shape
    schema = StructType([*PAYLOAD.fields, *flags, StructField("_bad", StringType())])
    parsed = F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    missing = F.trim(F.col(payload)) == "null"
    rows = raw.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull() | F.col("_p.id").isNull()
    fields = [(variant_bool(F.col(f"_p.{n}")) if n in FLAGS else F.col(f"_p.{n}")).alias(n) for n in only]
    rows = rows.withColumn("item", F.when(~bad & ~missing, F.struct(*fields)))
    return rows.withColumn("failure_class", F.when(bad & ~missing, "decode")).drop("_p")


def item_rows(decoded: DataFrame) -> DataFrame:
    """Table rows of decoded items: texts without NUL, derived domain and day, no lineage yet."""
    rows = decoded.filter("item IS NOT NULL").select("item.*").drop("kids")
    rows = rows.withColumns({name: text.strip_nul(F.col(name)) for name in text.TEXT_FIELDS})
    return rows.withColumns({"domain": text.url_domain(F.col("url")), "day": text.item_day(F.col("time")), "story_id": F.lit(None).cast("long")})


def kid_rows(decoded: DataFrame) -> DataFrame:
    """(item, kid, display_order): the payload's list of kids with its index."""
    kids = decoded.filter("item IS NOT NULL").select(F.col("item.id").alias("item"), F.posexplode("item.kids").alias("display_order", "kid"))
    return kids.select("item", "kid", F.col("display_order").cast("long").alias("display_order"))


def scripted_status(statuses: Column, attempt: Column) -> Column:
    """Status of the n-th attempt (from 1): the script's entry, or 200 once the script is exhausted."""
    return F.coalesce(F.get(statuses, attempt - 1), F.lit(200))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload) of a folder of JSON lines, one item a line; lines without an id are dropped. Any store Spark reads will do."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.id").try_cast("long").alias("id"), F.col("value").alias("payload"))
    return lines.filter("id IS NOT NULL")


def fetched(spark: SparkSession, start: int, end: int, payloads: DataFrame) -> DataFrame:
    """Ids start..end with their payload, or null where upstream has none."""
    return spark.range(start, end + 1).join(payloads, "id", "left")
