"""Operator 9: SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: text with A-Z lower-cased, words of the contract, three-word shingles with repeats, XXH64 (seed 42); a bit is
set if set in over half of the hashes. Two fingerprints link at ``RADIUS`` = 3 differing bits or fewer.

Candidates come from structured masks: every bit position has a vector of r + 1 = 4 bits; each of the 15 nonzero vectors
v gives the mask of positions whose vector has an even product with v. Three differing positions span at most
three dimensions, so some v is orthogonal to all of them: its mask leaves the pair's differences out, and the
pair has equal masked values in that table. No pair within the radius is missed, whatever the data.

Scale: copies reduce to one row per fingerprint first. A bucket of two is decided by one XOR. A bucket of more than ``CROWD`` is
split by masks again, over the 32 bits that its own mask leaves free, with the same guarantee; 16 bits stay free then, so that no such part
holds more than 65,536 fingerprints, whatever the data. Members of a smaller bucket or part meet in one task as 16-byte numbers; components there are grown breadth-first, each fingerprint being compared
only with those not reached yet, and each is linked to its component's root, so a bucket of n gives fewer
than n links and never its pairs. Components over all buckets follow from star contraction on the
deduplicated links. Connected components need no more links than these: each link between different fingerprints lies
inside some bucket, and in a bucket linked fingerprints share a root.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer than three words make one
shingle; rows of equal text or doc_id keep a row each; a null doc_id takes the smallest doc_id of its component, or null
if none has one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, byte_texts, documents, text_rows
from threadloom.llm.components import components

RADIUS, SHINGLE, SEED, BITS = 3, 3, 42, 64
CROWD = 10_000


def masks(kept: int = 0, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Covering masks over the bits that ``kept`` leaves free, each with ``kept``, as unsigned integers. The i-th free position has vector i mod 2^(radius+1), each used alike."""
    width, free = radius + 1, [i for i in range(bits) if not kept >> i & 1]
    return [kept | sum(1 << p for i, p in enumerate(free) if (i % 2**width & v).bit_count() % 2) for v in range(1, 2**width)]


def fingerprint(raw: bytes) -> int:
    tokens = raw.lower().split()
    if not tokens:
        return 0
    if len(tokens) < SHINGLE:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(tokens, tokens[1:], tokens[2:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[at : at + (1 << 15)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp), a hash of the text and the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in byte_texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found)], schema=schema)

    return text_rows(docs).withColumn("tag", F.xxhash64("text")).mapInArrow(run, "doc_id long, tag long, fp long")


def bucket_roots(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Index of the root of each fingerprint, for components at the radius inside one bucket.

    Breadth-first: what is reached once leaves the open set, so a dense bucket costs little more than its size.
    """
    roots = np.arange(len(fps))
    open_ = np.arange(len(fps))
    while len(open_):
        root, queue, open_ = open_[0], [open_[0]], open_[1:]
        while queue and len(open_):
            near = np.bitwise_count(fps[open_] ^ fps[queue.pop()]) <= radius
            if near.any():
                reached = open_[near]
                roots[reached] = root
                queue.extend(reached)
                open_ = open_[~near]
    return roots


def local_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside each bucket of ``members(t, key, fp, node)``, a bucket in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, nodes = None, [], []

        def flush():
            f, n = np.concatenate(fps).view(np.uint64), np.concatenate(nodes)
            roots = bucket_roots(f)
            out = roots != np.arange(len(f))
            return pa.RecordBatch.from_arrays([pa.array(n[roots[out]]), pa.array(n[out])], schema=schema)

        for b in batches:
            t, k, f, n = (b.column(i).to_numpy() for i in range(4))
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(t)], strict=True):
                if key is not None and key != (t[s], k[s]):
                    yield flush()
                    fps, nodes = [], []
                key = (t[s], k[s])
                fps.append(f[s:e])
                nodes.append(n[s:e])
        if fps:
            yield flush()

    return members.select("t", "key", "fp", "node").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masked(mask_of: list[tuple[int, int]]) -> Column:
    """Array of (t, key) for tables t and their masks."""
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in mask_of))


def bucketed(tables: DataFrame) -> DataFrame:
    """(t, key, n, and two members) of each bucket of at least two."""
    ends = (f(c).alias(name) for c, names in (("fp", ("f1", "f2")), ("node", ("n1", "n2"))) for f, name in zip((F.min, F.max), names, strict=True))
    return tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")


def links(prints: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect what is connected, from ``prints(fp, node)`` with one row per fingerprint."""
    first = list(enumerate(masks()))
    tables = prints.select("fp", "node", F.inline(masked(first)))
    buckets = scratch.table("buckets", bucketed(tables))
    again = F.coalesce(*(F.when(F.col("t") == t, masked([(len(first) * (t + 1) + i, x) for i, x in enumerate(masks(m))])) for t, m in first))
    inside = lambda name, where: tables.join(scratch.table(name, buckets.filter(where).select("t", "key")), ["t", "key"])
    split = scratch.table("split", inside("crowds", F.col("n") > crowd).select("fp", "node", again.alias("x")).select("fp", "node", F.inline("x")))
    parts = scratch.table("parts", bucketed(split))
    pairs = buckets.unionByName(parts).filter((F.col("n") == 2) & (F.bit_count(F.col("f1").bitwiseXOR(F.col("f2"))) <= RADIUS)).select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    members = inside("groups", F.col("n").between(3, crowd)).unionByName(split.join(parts.filter("n > 2").select("t", "key"), ["t", "key"]), allowMissingColumns=True)
    return pairs.unionByName(local_links(members))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp, root, component_id) for each row of docs: root names the component, component_id is its smallest doc_id, null if it has none."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.table("fingerprints", fingerprints(docs))
    prints = scratch.table("prints", own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    linked = components(links(prints.select("fp", F.col("fp").alias("node")), scratch), scratch)
    rooted = scratch.table("rooted", prints.join(linked, prints["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first_doc"))
    smallest = scratch.table("smallest", rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    return own.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component, the first by doc_id (null last), then by a hash of the text.

    Of rows that share doc_id and text any one stays.
    """
    scratch = Scratch(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    found = classes(docs).groupBy("root").agg(F.min(place).alias("first"))
    stay = scratch.table("stay", found.select(F.col("first.doc_id").alias("stay_doc"), F.col("first.tag").alias("stay_tag")))
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"own_doc": F.col("row.doc_id").cast("long"), "own_tag": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    kept = rows.join(stay, F.col("own_doc").eqNullSafe(F.col("stay_doc")) & (F.col("own_tag") == F.col("stay_tag"))).dropDuplicates(["own_doc", "own_tag"])
    return kept.select(*(F.col(f"row.{c}") for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
