"""Comment trees of all stories at once, with explicit reports of what does not fit.

Edges are classified and completed by joins. The depth-first walk, which attaches a comment once, under whichever parent comes to it first, and notices cycles,
works on tables too; no task ever walks a story.

A story's walk is a list: enter a comment, pass its children in order, leave it. Where a child is not attached by an edge, the list has a probe instead.
Each entry knows the one before it, so pointer jumping gives every entry its place in as many rounds as the list's length has binary digits, each
an equi-join of unique keys. The walk is right if each comment is entered by the first of its edges in that order. Comments that are not take that edge, and the walk
is listed again, until nothing changes: all that precedes the first wrong entry is right, and each round mends that entry. A new parent is
entered before its child in the walk that chose it, so attachments never form a cycle. Where every comment has one parent that can reach it, one list is enough.

Comments that no edge attaches hang on the story behind its own children, by id, as edges of last priority; so extra roots need no walk of their own. The first
list has such edges only for comments without a usable one: below the parents that it begins with, ids grow, so no other comment could come before its extra root.

Lists cost a shuffle of all entries a round. Stories of up to ``SHORT`` edges, which is nearly all of them, are dealt out whole instead, many to a task, and walked there with a stack,
which gives the same rows; only longer ones are walked as lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ordering import numbered
from threadloom.sources.scratch import Scratch

LAST = 9223372036854775807


def stories(items: DataFrame) -> DataFrame:
    return items.filter(F.col("type") == "story").select(F.col("id").alias("story_id"))


OUTSIDE = "EdgePointsOutsideStory"


def linked_members(items: DataFrame, kids: DataFrame) -> DataFrame:
    """(story_id, id): a snapshot of each story that follows edges: its comments, and the comments, of any story, that edges of it or of its comments name."""
    own = nodes(items)
    named = story_edges(items, kids).select("story_id", F.col("kid").alias("id")).join(items.filter("type = 'comment'").select("id"), "id", "left_semi")
    return own.select("story_id", "id").unionByName(named).distinct()


def nodes(items: DataFrame, include_deleted: bool = True, include_dead: bool = True, members: DataFrame | None = None) -> DataFrame:
    """(story_id, id, parent, visible, outside): comments of the stories that exist, or those of a snapshot ``members(story_id, id)``, which may be outside their story."""
    hidden = F.lit(False)
    for name, shown in (("deleted", include_deleted), ("dead", include_dead)):
        if not shown:
            hidden = hidden | F.coalesce(F.col(name), F.lit(False))
    comments = items.filter(F.col("type") == "comment").select(F.col("story_id").alias("_own"), "id", "parent", hidden.alias("_hidden"))
    if members is None:
        taken = comments.withColumn("story_id", F.col("_own"))
    else:
        taken = members.select("story_id", "id").join(comments, "id")
    outside = ~F.col("_own").eqNullSafe(F.col("story_id"))
    rows = taken.filter(F.col("id") != F.col("story_id")).select("story_id", "id", "parent", (~F.col("_hidden") & ~outside).alias("visible"), outside.alias("outside"))
    return rows.join(stories(items), "story_id", "left_semi")


def story_edges(items: DataFrame, kids: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(story_id, item, kid, display_order): edges whose parent is a story or one of its comments, or of the snapshot's ``own``."""
    comments = nodes(items) if own is None else own
    members = stories(items).select(F.col("story_id"), F.col("story_id").alias("item")).unionByName(comments.select("story_id", F.col("id").alias("item")))
    return kids.join(members, "item").select("story_id", "item", "kid", "display_order")


def _ends(own: DataFrame, mark: str) -> DataFrame:
    return own.select(*(F.col(c).alias(f"{mark}_{c}") for c in ("story_id", "id", "visible", "outside")))


def _broken(mark: str, missing: str, known: Column) -> Column:
    """Why an end is no comment to show, null if it is one: a reason of breaks, or silent where it is hidden. ``known`` ends need no row."""
    outcome = F.when(known, None).when(F.col(f"{mark}_id").isNull(), missing).when(F.col(f"{mark}_outside"), OUTSIDE)
    return outcome.when(~F.col(f"{mark}_visible"), "silent")


def classify_edges(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Adds ``outcome``: kept, silent (a hidden end), or the reason of the break."""
    joined = edges.join(_ends(own, "p"), (F.col("story_id") == F.col("p_story_id")) & (F.col("item") == F.col("p_id")), "left")
    joined = joined.join(_ends(own, "c"), (F.col("story_id") == F.col("c_story_id")) & (F.col("kid") == F.col("c_id")), "left")
    outcome = F.coalesce(_broken("p", "MissingParent", F.col("item") == F.col("story_id")), _broken("c", "MissingChild", F.lit(False)), F.lit("kept"))
    return joined.select(*edges.columns, outcome.alias("outcome"))


def fallback_edges(own: DataFrame) -> DataFrame:
    """(story_id, parent, id, outcome) of visible comments' own parent field: kept, silent, or the reason of the break."""
    joined = own.filter("visible").select("story_id", "parent", "id").join(_ends(own, "p"), (F.col("story_id") == F.col("p_story_id")) & (F.col("parent") == F.col("p_id")), "left")
    outcome = F.coalesce(_broken("p", "MissingParent", F.coalesce(F.col("parent") == F.col("story_id"), F.lit(False))), F.lit("kept"))
    return joined.select("story_id", "parent", "id", outcome.alias("outcome"))


def kept_edges(classified: DataFrame, fallback: DataFrame) -> DataFrame:
    """(story_id, parent, child, priority, ord): explicit edges, and fallback ones behind them; a pair may be in both."""
    explicit = classified.filter("outcome = 'kept'").select("story_id", F.col("item").alias("parent"), F.col("kid").alias("child"), F.lit(0).alias("priority"), F.coalesce("display_order", F.lit(LAST)).alias("ord"))
    implied = fallback.filter("outcome = 'kept'").select("story_id", "parent", F.col("id").alias("child"), F.lit(1).alias("priority"), F.lit(LAST).alias("ord"))
    return explicit.unionByName(implied)


def _first_of_pairs(edges: DataFrame) -> DataFrame:
    first = edges.groupBy("story_id", "parent", "child").agg(F.min(F.struct("priority", "ord")).alias("k"))
    return first.select("story_id", "parent", "child", "k.priority", "k.ord")


def children(classified: DataFrame, fallback: DataFrame) -> DataFrame:
    """(story_id, parent, child, priority, ord): explicit edges before fallback ones, each pair once."""
    return _first_of_pairs(kept_edges(classified, fallback))


EXTRA = 2  # priority of the edges that hang every comment on its story
USABLE = "parent = story_id OR parent < child"  # edges to begin with, which form no cycle


def adjacency(lists: DataFrame, own: DataFrame, scratch: Scratch, every: bool = True) -> DataFrame:
    """(at, story_id, parent, child, extra, last, head): all edges, numbered in the order of parents and of their children.

    ``last``: no edge of the parent follows; the next one's number is at + 1. ``head``: the number of the child's own first edge, null without any.
    ``every`` comment that is no child of its story has an extra edge, or only those whose other edges cannot be begun with.
    """
    extra = own.filter("visible").select("story_id", F.col("story_id").alias("parent"), F.col("id").alias("child"), F.lit(EXTRA).alias("priority"), F.lit(LAST).alias("ord"))
    # A story's own child has an edge to it already, which comes before.
    tops = lists.filter("parent = story_id" if every else USABLE).select("story_id", "child")
    edges = lists.unionByName(extra.join(tops, ["story_id", "child"], "left_anti"))
    placed = numbered(edges, ["parent", "priority", "ord", "child"], "at", scratch, "sorted")
    after = placed.select((F.col("at") - 1).alias("at"), F.col("parent").alias("_next"))
    heads = placed.groupBy(F.col("parent").alias("child")).agg(F.min("at").alias("head"))
    known = placed.join(after, "at", "left").join(heads, "child", "left")
    last = F.coalesce(F.col("_next") != F.col("parent"), F.lit(True))
    return scratch.table("adjacency", known.select("at", "story_id", "parent", "child", (F.col("priority") == EXTRA).alias("extra"), last.alias("last"), "head"))


def attached_first(edges: DataFrame) -> DataFrame:
    """(child, at): an attachment to begin with, free of cycles: to the story, or to the comment of the smallest id if that is below the child's, as parents' are."""
    return edges.filter(USABLE).groupBy("child").agg(F.min_by("at", F.struct("extra", "parent")).alias("at"))


SUMS = ("n", "entered", "left", "extras")


def _entries(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(entry, before, n, entered, left, extras): links of the list, with what the entry before it adds. An entry is twice its edge's number, the leave of a child one
    more. A child without edges is entered and left at once."""
    mine = edges.join(chosen.select(F.col("at"), F.lit(True).alias("tree")), "at", "left").withColumn("tree", F.col("tree").isNotNull())
    above = chosen.select(F.col("child").alias("parent"), F.col("at").alias("_up"), F.lit(True).alias("last"))
    mine = mine.join(above, ["parent", "last"], "left")  # an edge that is its parent's last is followed by the parent's leave
    enter, leave = F.col("at") * 2, F.col("at") * 2 + 1
    following = F.when(~F.col("last"), (F.col("at") + 1) * 2).otherwise(F.col("_up") * 2 + 1)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tree, opens = F.col("tree"), F.col("tree") & F.col("head").isNotNull()
    first = F.struct(F.when(opens, F.col("head") * 2).otherwise(following).alias("entry"), enter.alias("before"), F.when(tree & ~opens, 2).otherwise(one).alias("n"), tree.cast("long").alias("entered"), (tree & ~opens).cast("long").alias("left"), (tree & F.col("extra")).cast("long").alias("extras"))
    second = F.when(opens, F.struct(following.alias("entry"), leave.alias("before"), one.alias("n"), zero.alias("entered"), one.alias("left"), zero.alias("extras")))
    return mine.select(F.inline(F.array_compact(F.array(first, second)))).filter("entry IS NOT NULL")


def listed(edges: DataFrame, chosen: DataFrame, rounds: int, scratch: Scratch, name: str) -> DataFrame:
    """(entry, n, entered, left, extras): for each entry but a story's first, how many entries, enters, leaves and extra roots come before it."""
    state = scratch.table(f"{name}0", _entries(edges, chosen))
    for k in range(rounds):
        back = state.select(F.col("entry").alias("before"), F.col("before").alias("_before"), *(F.col(c).alias(f"_{c}") for c in SUMS))
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS]
        after = scratch.table(f"{name}{k + 1}", state.join(back, "before", "left").select("entry", F.col("_before").alias("before"), *sums))
        scratch.drop(f"{name}{k}")
        state = after
    return state.drop("before")


def walked(lists: DataFrame, own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(tree, cycles). Tree: story_id, id, parent (null for an extra root), depth, orphan, pos. Cycles: story_id, parent, child of edges to a comment on the walk's path."""
    own = own.filter("visible").select("story_id", "id", "visible")
    edges, k = adjacency(lists, own, scratch, every=False), 0
    chosen, every = scratch.table("chosen", attached_first(edges)), False
    while True:
        longest = edges.groupBy("story_id").agg(F.sum(1 + F.col("head").isNotNull().cast("int")).alias("entries")).agg(F.max("entries")).first()[0] or 1
        times = listed(edges, chosen, math.ceil(math.log2(longest)), scratch, f"list{k}-")
        timed = edges.join(times, F.col("at") * 2 == F.col("entry"), "left").select(edges["*"], *(F.coalesce(c, F.lit(0)).alias(c) for c in SUMS))
        timed = scratch.table(f"timed{k}", timed)
        first = scratch.table(f"chosen{k}", timed.groupBy("child").agg(F.min_by("at", "n").alias("at")))
        if first.join(chosen, ["child", "at"], "left_anti").isEmpty():
            break
        if every:
            chosen = first
        else:
            edges, every = adjacency(lists, own, scratch), True
            chosen = scratch.table("chosen", attached_first(edges))
        k += 1
    tree = timed.join(chosen.select("at"), "at", "left_semi")
    orphan = (F.col("extras") > 0) | F.col("extra")
    rows = tree.select("story_id", F.col("child").alias("id"), F.when(~F.col("extra"), F.col("parent")).alias("parent"), (F.col("entered") - F.col("left") + 1).cast("int").alias("depth"), orphan.alias("orphan"), F.col("entered").cast("int").alias("pos"))
    # An edge that was passed while its child was entered and not yet left leads back to the path.
    probes = timed.filter(~F.col("extra")).select("at", "story_id", "parent", "child", "n").join(chosen.select("at"), "at", "left_anti")
    left = chosen.select("child", (F.col("at") * 2 + 1).alias("entry")).join(times.select("entry", F.col("n").alias("end")), "entry")
    cycles = probes.join(left, "child").filter("n < end").select("story_id", "parent", "child")
    return rows, cycles


SHORT = 20_000  # edges of a story that is walked whole
WALKED = "story_id long, id long, parent long, depth int, orphan boolean, pos int, cycle boolean"


def _walk(story: int, parents: list[int], childs: list[int], extras: list[bool]) -> Iterator[tuple]:
    """Rows of ``WALKED`` of one story, from edges in the order of parents and of their children."""
    first, end = {}, {}
    for at, parent in enumerate(parents):
        first.setdefault(parent, at)
        end[parent] = at + 1
    entered, path, cycles, pos = set(), set(), set(), 0
    stack = [[story, first.get(story, 0), end.get(story, 0), False]]
    while stack:
        top = stack[-1]
        item, at, stop, orphan = top
        if at == stop:
            path.discard(item)
            stack.pop()
            continue
        top[1] = at + 1
        child, extra = childs[at], extras[at]
        if child not in entered:
            entered.add(child)
            path.add(child)
            orphan = orphan or extra
            yield story, child, None if extra else item, len(stack), orphan, pos, False
            pos += 1
            stack.append([child, first.get(child, 0), end.get(child, 0), orphan])
        elif child in path and not extra and (item, child) not in cycles:
            cycles.add((item, child))
            yield story, child, item, None, None, None, True


def _walks(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Stories, which lie together, one after another; a batch may end inside one."""
    schema = pa.schema([("story_id", pa.int64()), ("id", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("orphan", pa.bool_()), ("pos", pa.int32()), ("cycle", pa.bool_())])
    made, story, edges = [], None, ([], [], [])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    for batch in batches:
        stories, *columns = (c.to_pylist() for c in batch.columns)
        ends = [k for k in range(1, len(stories)) if stories[k] != stories[k - 1]]
        for low, high in zip([0, *ends], [*ends, len(stories)]):
            if low == high:
                continue
            if stories[low] != story:
                made.extend(_walk(story, *edges) if story is not None else ())
                story, edges = stories[low], ([], [], [])
            for held, new in zip(edges, columns):
                held.extend(new[low:high])
            if len(made) >= rows:
                yield out()
                made.clear()
    if story is not None:
        made.extend(_walk(story, *edges))
    if made:
        yield out()


def walked_by_length(edges: DataFrame, own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What ``walked`` gives for ``kept_edges``: short stories are walked whole, long ones as lists."""
    shown = own.filter("visible").select("story_id", "id", "visible")
    extra = shown.select("story_id", F.col("story_id").alias("parent"), F.col("id").alias("child"), F.lit(EXTRA).alias("priority"), F.lit(LAST).alias("ord"))
    every = edges.unionByName(extra)
    long = scratch.table("long", every.groupBy("story_id").count().filter(F.col("count") > SHORT).select("story_id"))
    some = not long.isEmpty()
    short = every.join(long, "story_id", "left_anti") if some else every
    dealt = short.repartition("story_id").sortWithinPartitions("story_id", "parent", "priority", "ord", "child")
    made = scratch.table("walked", dealt.select("story_id", "parent", "child", (F.col("priority") == EXTRA).alias("extra")).mapInArrow(_walks, WALKED))
    tree, cycles = made.filter("NOT cycle").drop("cycle"), made.filter("cycle").select("story_id", "parent", F.col("id").alias("child"))
    if some:
        rows, back = walked(_first_of_pairs(edges.join(long, "story_id", "left_semi")), shown.join(long, "story_id", "left_semi"), scratch)
        tree, cycles = tree.unionByName(rows), cycles.unionByName(back)
    return tree, cycles


def assemble(items: DataFrame, kids: DataFrame, include_deleted: bool = True, include_dead: bool = True, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree rows, breaks) of every story, or of the snapshot ``members(story_id, id)`` of each, whose comments of other stories are breaks.

    Tree rows: story_id, id, parent (null for an extra root), depth (1 at the top), orphan, pos (depth-first). Breaks are a multiset.
    """
    scratch = Scratch(items.sparkSession)
    own = scratch.table("own", nodes(items, include_deleted, include_dead, members))
    classified = scratch.table("classified", classify_edges(story_edges(items, kids, own), own))
    fallback = scratch.table("fallback", fallback_edges(own))
    tree, cycles = walked_by_length(kept_edges(classified, fallback), own, scratch)
    lost = tree.filter("orphan").select("story_id", "id").join(own.filter("parent <> story_id").select("story_id", "id", "parent"), ["story_id", "id"])
    named = lambda df, reason, parent, child: df.select("story_id", reason.alias("reason"), F.col(parent).alias("parent_id"), F.col(child).alias("child_id"))
    breaks = named(classified.filter("outcome NOT IN ('kept', 'silent')"), F.col("outcome"), "item", "kid")
    breaks = breaks.unionByName(named(fallback.filter("outcome NOT IN ('kept', 'silent')"), F.col("outcome"), "parent", "id"))
    breaks = breaks.unionByName(named(lost, F.lit("MissingParent"), "parent", "id")).unionByName(named(cycles, F.lit("CycleDetected"), "parent", "child"))
    breaks = breaks.unionByName(named(own.filter("outside"), F.lit(OUTSIDE), "parent", "id"))
    return tree, breaks


def story_tree(items: DataFrame, kids: DataFrame, story_id: int) -> tuple[DataFrame, DataFrame]:
    """One story's tree: the filters reach the scans. Raises KeyError if it is missing and ValueError if no story."""
    root = items.filter(F.col("id") == story_id).select("type").head()
    if root is None:
        raise KeyError(story_id)
    if root[0] != "story":
        raise ValueError(f"item {story_id} is a {root[0]}")
    return assemble(items.filter((F.col("id") == story_id) | (F.col("story_id") == story_id)), kids)
