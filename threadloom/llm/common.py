"""What the training-data operators share: reading, scratch tables, tokens, position keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.scratch import Scratch

__all__ = ["Scratch", "arrow_rows", "byte_texts", "documents", "held_out", "text_rows", "to_batch", "words"]

#: Separators of the contract's words ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these six.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, with null texts read as empty: extra columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Array of the contract's words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty. bytes.lower() folds only A-Z and bytes.split() is ASCII."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


def arrow_rows(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Runs ``make(batch) -> iterable of row tuples`` and yields record batches of bounded size."""
    held: list[tuple] = []
    for batch in batches:
        for row in make(batch):
            held.append(row)
            if len(held) >= size:
                yield to_batch(held, schema)
                held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
