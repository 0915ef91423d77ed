"""Operator 11: conversation structure repair by A* on the edit lattice.

A conversation is its rows by turn (null turns first; rows of one turn by role, then by the text's first ``OPENING`` characters, then by two hashes of it). A row's first fault counts: blank (nothing but ASCII
white space), duplicate (a row before it has its role and text), truncated (its last character but white space is none of ``.!?``).

The lattice's nodes are (rows consumed, state of the grammar ``(s?(ua)+)?`` over role initials). Edges are edits: Keep 0, Rerole to user
or assistant 1, Delete 2, Insert an empty turn 5; blank and duplicate rows can only be deleted, a truncated row that stays adds 5. A* expands nodes by
(cost + heuristic, audit), the audit being the initials of the edits so far. The heuristic is a suffix sum over the rows left: 2 for each mandatory
deletion, and 2 for each truncated row, which costs at least its deletion. It never exceeds the true rest and never falls by more than an edge costs.
An audit fixes the state and the cost, and of two audits that reach a node at equal cost neither begins the other, so
the first visit of a node has its cheapest, ASCII-least audit.

Scale: rows without their texts (but for the openings, which order ties) are range-sorted by their place, so a conversation with a third of all rows lies in many tasks. Their place is cut
into blocks of ``BLOCK`` rows; each (conversation, block) is searched by itself, from each of the four states, for the best way to each of the four. The ways of a
conversation's blocks are then put together in order, one string of edits a block; what goes to one task is of the size of the audit, which the result holds in
one cell. Duplicates are found as rows that are not the first of their (conversation, role, text), by an aggregate and a join on the place, which is unique. Texts move once,
to be streamed in order past their conversation's edits; no task holds more than one batch of them. (The digest of a
conversation hashes its texts in order, so they pass through one task one after another.)

Defined cases: null roles and texts are one space, so null texts are blank; rows without a conv_id are one conversation; null turns count for order, not for gaps; a conversation
without rows has zeros, an empty audit and no repaired rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, arrow_rows

BLOCK, OPENING = 512, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\f\r"
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's. The role that each lets follow, and its state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ENDS = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with null roles and texts as one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the benchmark of this operator plants, chosen by crc32 of conv_id and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    marked = rows.withColumn("fate", F.crc32(key.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def ordered_keys(rows: DataFrame) -> DataFrame:
    """Adds what orders rows of one turn and role: the text's opening, and two hashes, which also tell texts apart."""
    return rows.withColumns({"opening": F.substring("text", 1, OPENING), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), F.col("text"))})


PLACE = ("conv_id", "turn", "role", "opening", "h1", "h2")


def lattice_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, pos, initial, fault, code) of each row: pos grows in the order of conversations and turns.

    A code is D for a row that must go, else the role's initial (x for all others), in capitals if the row is truncated.
    """
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    slim = ordered_keys(rows).select(
        *PLACE, initial.alias("initial"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("nth"),
    )
    placed = slim.repartitionByRange(*PLACE, "nth").sortWithinPartitions(*PLACE, "nth").withColumn("pos", F.monotonically_increasing_id())
    placed = scratch.table("placed", placed.select("conv_id", "turn", "role", "h1", "h2", "initial", "blank", "cut", "pos"))
    firsts = placed.groupBy("conv_id", "role", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    known = placed.join(firsts, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return known.select("conv_id", "turn", "pos", "initial", fault.alias("fault")).withColumn("code", code)


@lru_cache(maxsize=4096)
def ways(codes: str, start: int, ends: tuple[int, ...] = (NOTHING, SYSTEM, USER, ASSISTANT)) -> dict[int, tuple[int, str]]:
    """A*: cheapest (cost, audit), ties ASCII-least, from a state before the rows of ``codes`` to each state of ``ends`` after them that can be reached."""
    n = len(codes)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if codes[i] == "D" or codes[i].isupper() else 0)
    found: dict[int, tuple[int, str]] = {}
    closed: set[tuple[int, int]] = set()
    queue = [(least[0], "", 0, start)]
    while queue and len(found) < len(ends):
        bound, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = bound - least[i]
        if i == n and state in ends:
            found[state] = (cost, audit)
        role, after = NEXT[state]
        steps = [(INSERT, "I", i, after)]
        if i < n:
            code = codes[i]
            steps.append((DELETE, "D", i + 1, state))
            if code != "D":
                extra = TRUNCATED if code.isupper() else 0
                if code.lower() == role:
                    steps.append((KEEP + extra, "K", i + 1, after))
                else:
                    steps.append((REROLE + extra, "R", i + 1, after))
                if code.lower() == "s" and state == NOTHING:
                    steps.append((KEEP + extra, "K", i + 1, SYSTEM))
        for price, letter, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + price + least[j], audit + letter, j, to))
    return found


WAYS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
WAYS_DDL = "conv_id long, block long, illegal long, initials string, costs array<long>, audits array<string>"


def _block_ways(batch: pa.RecordBatch) -> Iterator[tuple]:
    for conv, block, initials, codes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        costs, audits = [], []
        for start in range(4):
            found = ways(codes, start)
            for end in range(4):
                cost, audit = found.get(end, (-1, ""))
                costs.append(cost)
                audits.append(audit)
        illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
        yield conv, block, illegal, initials[0] + initials[-1], costs, audits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _conversation(parts: Iterator[tuple]) -> tuple[int, int, str]:
    """(illegal, cost, audit) of a conversation from the ways of its blocks in order. What all states' audits share is settled."""
    best, settled, illegal, last = {NOTHING: (0, "")}, [], 0, ""
    for _, _, inside, ends, costs, audits in parts:
        illegal += inside + (last != "" and last + ends[0] not in LEGAL)
        last, after = ends[1], {}
        for state, (cost, audit) in best.items():
            for end in range(4):
                price = costs[4 * state + end]
                if price >= 0:
                    way = (cost + price, audit + audits[4 * state + end])
                    after[end] = min(after.get(end, way), way)
        shared = os.path.commonprefix([audit for _, audit in after.values()])
        settled.append(shared)
        best = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in after.items()}
    cost, audit = min(best[state] for state in ENDS if state in best)
    return illegal, cost, "".join(settled) + audit


PLAN = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def plans(lattice: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation that has rows."""
    entry = F.array_sort(F.collect_list(F.struct("pos", "initial", "code")))
    letters = lambda name: F.array_join(F.transform("entries", lambda x: x[name]), "").alias(name)
    blocks = lattice.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(entry.alias("entries"))
    blocks = blocks.select("conv_id", "block", letters("initial"), letters("code"))
    searched = blocks.mapInArrow(lambda batches: arrow_rows(batches, _block_ways, WAYS, 2000), WAYS_DDL)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((conv, *_conversation(parts)) for conv, parts in groupby(_rows(batches), key=lambda row: row[0]))
        return arrow_rows([made], lambda rows: rows, PLAN, 2000)

    ordered = searched.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return scratch.table("plans", ordered.mapInArrow(settle, "conv_id long, illegal long, cost long, audit string"))


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
REPAIRED_DDL = "conv_id long, place long, role string, text string"


def _edited(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of a repaired conversation. The first row brings the audit, the others follow in order."""
    audit, at, state = next(rows)[1], 0, NOTHING

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = NEXT[state]
            at += 1
            yield ROLES[role], ""

    for _, _, role, text in rows:
        yield from inserted()
        letter, at = audit[at], at + 1
        if letter == "D":
            continue
        needed, after = NEXT[state]
        if letter == "R":
            role = ROLES[needed]
        state = SYSTEM if letter == "K" and state == NOTHING and role[:1] == "s" else after
        yield role, text
    yield from inserted()


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired rows, each partition in the order of its conversations and their places."""
    nothing = {"turn": "long", "role": "string", "text": "string", "opening": "string", "h1": "long", "h2": "long"}
    heads = plan.select("conv_id", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    bodies = ordered_keys(rows).select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *nothing)
    ordered = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *PLACE[1:]).select("conv_id", "audit", "role", "text")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((conv, place, *row) for conv, rows in groupby(_rows(batches), key=lambda row: row[0]) for place, row in enumerate(_edited(rows)))
        return arrow_rows([made], lambda rows: rows, REPAIRED, 1000)

    return ordered.mapInArrow(edit, REPAIRED_DDL)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as ``repaired`` returns them: of ``role:text``, joined by newlines."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches), key=lambda row: row[0]):
                whole = hashlib.sha256()
                for _, place, role, text in rows:
                    whole.update(("\n" * (place > 0) + role + ":" + text).encode())
                yield conv, whole.hexdigest()

        return arrow_rows([made()], lambda rows: rows, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return repaired_rows.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of rows (conv_id, turn, role, text). The report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    scratch = Scratch(rows.sparkSession)
    lattice = scratch.table("lattice", lattice_rows(rows, scratch))
    plan = plans(lattice, scratch)
    counted = [F.sum((F.col("fault") == name).cast("long")).alias(name) for name in ("blank", "duplicate", "truncated")]
    faults = lattice.groupBy("conv_id").agg(*counted, F.min("turn").alias("first"), F.max("turn").alias("last"))
    turns = lattice.filter("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    report = faults.alias("f").join(turns.alias("t"), F.col("f.conv_id").eqNullSafe(F.col("t.conv_id")), "left").join(plan.alias("p"), F.col("f.conv_id").eqNullSafe(F.col("p.conv_id")))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return report.select("f.conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired(rows, plan)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = rows_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    report, rows = repair(damaged(original))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = original.select("conv_id").distinct().alias("c").join(report.alias("r"), F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    joined = joined.join(digests(rows).alias("d"), F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("c.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
