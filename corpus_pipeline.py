"""A training corpus from raw documents in five stages, each but the last written as Parquet and read back by the next.

Quality rules clean lines and reject documents; line dedup removes repeated three-line windows and the documents it
empties; SimHash keeps the first document of each near-duplicate group; decontamination drops documents with too much of a
benchmark; mixing returns the documents with their words to take and their training position, in training order.

Defined cases: null and empty texts fail the first stage. Rows that share a doc_id, or have none, are documents of their own in every stage, but that copies
of a row count as one for line dedup; one row of a near-duplicate group stays, whatever ids its rows share. Empty tables give empty tables; extra columns pass through, but for those
that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import op01_quality, op04_line_dedup, op06_decontamination, op09_simhash, op10_mixing
from threadloom.llm.common import Scratch, words


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, n_chars following the text."""
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, op01_quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, op04_line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.size(words(F.col("text"))) > 0)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL has no XXH64, on which the third stage's groups depend; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:  # not written and read back, which would lose its order; it reads the table before when it is asked for rows
            return made
        docs = scratch.table(name, made)
        if k:
            scratch.drop(STAGES[k - 1][0])
