"""Queries on threads and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import lineage, render, threads, upsert
from threadloom.plans.fixtures import frame, oracle
from threadloom.plans.registry import query
from threadloom.sources.scratch import Scratch

NOW = 1300000000

#: Edges and depth-first order of a forest whose parents have smaller ids, as the fixtures are. {hidden} filters comments.
TREE = """WITH RECURSIVE own AS (SELECT * FROM fx_items WHERE type = 'comment' AND NOT ({hidden})),
all_comments AS (SELECT * FROM fx_items WHERE type = 'comment'),
roots AS (SELECT id FROM fx_items WHERE type = 'story'),
explicit AS (SELECT c.story_id, k.item AS parent, k.kid AS child, 0 AS pri, k.display_order AS ord FROM fx_kids k JOIN own c ON c.id = k.kid
  LEFT JOIN own p ON p.id = k.item AND p.story_id = c.story_id WHERE c.story_id IN (SELECT id FROM roots) AND (k.item = c.story_id OR p.id IS NOT NULL)),
implied AS (SELECT c.story_id, c.parent, c.id AS child, 1 AS pri, 9223372036854775807 AS ord FROM own c LEFT JOIN own p ON p.id = c.parent AND p.story_id = c.story_id
  WHERE c.story_id IN (SELECT id FROM roots) AND (c.parent = c.story_id OR p.id IS NOT NULL)),
edges AS (SELECT story_id, parent, child, min(pri) AS pri, arg_min(ord, pri) AS ord FROM (SELECT * FROM explicit UNION ALL SELECT * FROM implied) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY story_id, parent ORDER BY pri, ord, child) AS r FROM edges),
tree AS (
  SELECT e.story_id, e.child AS id, CAST(NULL AS BIGINT) AS parent, 1 AS depth, FALSE AS orphan, [CAST(0 AS BIGINT), e.r] AS path FROM ranked e WHERE e.parent = e.story_id
  UNION ALL SELECT o.story_id, o.id, NULL, 1, TRUE, [CAST(1 AS BIGINT), o.id] FROM own o WHERE o.story_id IN (SELECT id FROM roots) AND o.id NOT IN (SELECT child FROM ranked)
  UNION ALL SELECT t.story_id, e.child, t.id, t.depth + 1, t.orphan, list_append(t.path, e.r) FROM tree t JOIN ranked e ON e.story_id = t.story_id AND e.parent = t.id),
placed AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY path) - 1 AS pos FROM tree)
"""
ROWS = "SELECT story_id, id, coalesce(parent, CASE WHEN orphan THEN NULL ELSE story_id END) AS parent, CAST(depth AS INT) AS depth, orphan, CAST(pos AS INT) AS pos FROM placed"
HIDDEN = "coalesce(deleted, FALSE) OR coalesce(dead, FALSE)"
VIEWS = ("fx_items", "fx_kids")


def _data(spark, sf_dir):
    """Items and edges once written: a dozen joins read them, and the views behind them rank and sort."""
    scratch = Scratch(spark)
    return scratch.table("items", frame(spark, sf_dir, "fx_items")), scratch.table("kids", frame(spark, sf_dir, "fx_kids"))


@query(oracle(TREE.format(hidden="FALSE") + ROWS, *VIEWS))
def thread_tree(spark, sf_dir):
    return threads.assemble(*_data(spark, sf_dir))[0]


@query(oracle(TREE.format(hidden=HIDDEN) + ROWS, *VIEWS))
def thread_tree_visible(spark, sf_dir):
    return threads.assemble(*_data(spark, sf_dir), include_deleted=False, include_dead=False)[0]


@query(oracle(TREE.format(hidden="FALSE") + """, broken AS (
  SELECT coalesce(c.story_id, k.item) AS story_id, 'MissingChild' AS reason, k.item AS parent_id, k.kid AS child_id FROM fx_kids k JOIN fx_items c ON c.id = k.item
    LEFT JOIN own x ON x.id = k.kid AND x.story_id = c.story_id WHERE x.id IS NULL
  UNION ALL SELECT c.story_id, 'MissingParent', c.parent, c.id FROM own c LEFT JOIN own p ON p.id = c.parent AND p.story_id = c.story_id WHERE p.id IS NULL AND c.parent IS DISTINCT FROM c.story_id
  UNION ALL SELECT t.story_id, 'MissingParent', o.parent, t.id FROM placed t JOIN own o ON o.id = t.id WHERE t.orphan AND o.parent IS NOT NULL AND o.parent <> o.story_id)
SELECT * FROM broken""", *VIEWS))
def thread_breaks(spark, sf_dir):
    return threads.assemble(*_data(spark, sf_dir))[1]


@query(oracle(TREE.format(hidden="FALSE") + "SELECT story_id, id FROM placed WHERE orphan AND depth = 1", *VIEWS))
def thread_orphans(spark, sf_dir):
    return threads.assemble(*_data(spark, sf_dir))[0].filter("orphan AND depth = 1").select("story_id", "id")


@query(oracle(TREE.format(hidden="FALSE") + "SELECT story_id, count(*) AS n_comments FROM placed GROUP BY story_id", *VIEWS))
def tree_comment_count(spark, sf_dir):
    return threads.assemble(*_data(spark, sf_dir))[0].groupBy("story_id").agg(F.count(F.lit(1)).alias("n_comments"))


EDGES = """WITH members AS (SELECT id AS story_id, id AS item FROM fx_items WHERE type = 'story' UNION ALL
  SELECT story_id, id FROM fx_items WHERE type = 'comment' AND story_id IN (SELECT id FROM fx_items WHERE type = 'story'))
"""


@query(oracle(EDGES + "SELECT story_id, k.item, k.kid, k.display_order FROM fx_kids k JOIN members m ON m.item = k.item ORDER BY k.item, k.display_order NULLS LAST, k.kid", *VIEWS))
def kid_edges_for_story(spark, sf_dir):
    edges = threads.story_edges(frame(spark, sf_dir, "fx_items"), frame(spark, sf_dir, "fx_kids"))
    return edges.orderBy("item", F.col("display_order").asc_nulls_last(), "kid")


@query(oracle(EDGES + """, own AS (SELECT story_id, id, NOT (""" + HIDDEN + """) AS visible FROM fx_items WHERE type = 'comment')
SELECT m.story_id, k.item, k.kid, k.display_order, CASE WHEN k.item <> m.story_id AND NOT p.visible THEN 'silent' WHEN c.id IS NULL THEN 'MissingChild' WHEN NOT c.visible THEN 'silent' ELSE 'kept' END AS outcome
FROM fx_kids k JOIN members m ON m.item = k.item LEFT JOIN own p ON p.id = k.item AND p.story_id = m.story_id LEFT JOIN own c ON c.id = k.kid AND c.story_id = m.story_id""", *VIEWS))
def classify_edges(spark, sf_dir):
    items, kids = _data(spark, sf_dir)
    return threads.classify_edges(threads.story_edges(items, kids), threads.nodes(items, False, False))


@query(oracle("WITH own AS (SELECT story_id, id, parent, NOT (" + HIDDEN + """) AS visible FROM fx_items WHERE type = 'comment')
SELECT c.story_id, c.parent, c.id, CASE WHEN c.parent = c.story_id THEN 'kept' WHEN p.id IS NULL THEN 'MissingParent' WHEN NOT p.visible THEN 'silent' ELSE 'kept' END AS outcome
FROM own c LEFT JOIN own p ON p.id = c.parent AND p.story_id = c.story_id WHERE c.visible AND c.story_id IN (SELECT id FROM fx_items WHERE type = 'story')""", "fx_items"))
def fallback_edges(spark, sf_dir):
    return threads.fallback_edges(threads.nodes(frame(spark, sf_dir, "fx_items"), False, False))


@query(oracle(TREE.format(hidden="FALSE") + "SELECT story_id, parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY r) AS children FROM ranked GROUP BY story_id, parent", *VIEWS))
def children_lists(spark, sf_dir):
    items, kids = _data(spark, sf_dir)
    own = threads.nodes(items)
    lists = threads.children(threads.classify_edges(threads.story_edges(items, kids), own), threads.fallback_edges(own))
    ordered = F.array_sort(F.collect_list(F.struct("priority", "ord", "child")))
    return lists.groupBy("story_id", "parent").agg(F.array_join(F.transform(ordered, lambda x: x["child"].cast("string")), ",").alias("children"))


LINEAGE = """WITH RECURSIVE found AS (SELECT id, coalesce(story_id, CASE WHEN type = 'story' THEN id END) AS label FROM fx_bare WHERE story_id IS NOT NULL OR type = 'story'
  UNION ALL SELECT c.id, f.label FROM fx_bare c JOIN found f ON f.id = c.parent WHERE c.type = 'comment' AND c.story_id IS NULL)
"""


@query(oracle(LINEAGE + "SELECT b.id, f.label AS story_id FROM fx_bare b LEFT JOIN found f USING (id)", "fx_bare"))
def backfill_fixpoint(spark, sf_dir):
    return lineage.backfill(frame(spark, sf_dir, "fx_bare")).select("id", "story_id")


@query(oracle("""WITH RECURSIVE batch AS (SELECT * FROM fx_bare WHERE id % 100 >= 25), known AS (SELECT id, CASE WHEN type = 'story' THEN id ELSE story_id END AS label FROM fx_bare WHERE id % 100 < 25),
found AS (SELECT id, id AS label FROM batch WHERE type = 'story' UNION ALL SELECT id, label FROM known WHERE label IS NOT NULL
  UNION ALL SELECT c.id, f.label FROM batch c JOIN found f ON f.id = c.parent WHERE c.type = 'comment')
SELECT b.id, f.label AS story_id FROM batch b LEFT JOIN found f USING (id)""", "fx_bare"))
def resolve_story_ids(spark, sf_dir):
    bare = frame(spark, sf_dir, "fx_bare")
    return lineage.resolve(bare.filter("id % 100 >= 25"), bare.filter("id % 100 < 25")).select("id", "story_id")


READY = """SELECT c.id, coalesce(p.story_id, c.parent) AS story_id FROM fx_bare c JOIN fx_bare p ON p.id = c.parent
WHERE c.type = 'comment' AND c.story_id IS NULL AND (p.story_id IS NOT NULL OR p.type = 'story') ORDER BY c.id LIMIT 500"""


@query(oracle(READY, "fx_bare"))
def backfill_batch(spark, sf_dir):
    return lineage.backfill_batch(frame(spark, sf_dir, "fx_bare"), 500)


@query(oracle("WITH b AS (" + READY + ") SELECT t.id, coalesce(b.story_id, t.story_id) AS story_id FROM fx_bare t LEFT JOIN b USING (id)", "fx_bare"))
def update_from(spark, sf_dir):
    bare = frame(spark, sf_dir, "fx_bare")
    return upsert.update_from(bare, lineage.backfill_batch(bare, 500), "id", ["story_id"]).select("id", "story_id")


@query(oracle("SELECT id, CASE WHEN type = 'story' THEN coalesce(story_id, id) ELSE story_id END AS story_id FROM fx_bare", "fx_bare"))
def seed_story_rows(spark, sf_dir):
    return lineage.seed_stories(frame(spark, sf_dir, "fx_bare")).select("id", "story_id")


@query(oracle("SELECT count(*) AS n_changed FROM fx_bare WHERE type = 'story' AND story_id IS NULL", "fx_bare"))
def seeded_count(spark, sf_dir):
    bare = frame(spark, sf_dir, "fx_bare")
    return lineage.changed_count(bare, lineage.seed_stories(bare))


@query(oracle("SELECT count(*) AS n_unresolved FROM fx_bare WHERE type = 'comment' AND story_id IS NULL", "fx_bare"))
def unresolved_comments(spark, sf_dir):
    return lineage.unresolved_comments(frame(spark, sf_dir, "fx_bare"))


@query(oracle("SELECT c.id, p.id AS parent_id, p.type AS parent_type FROM fx_items c JOIN fx_items p ON p.id = c.parent", "fx_items"))
def parent_child_join(spark, sf_dir):
    items = frame(spark, sf_dir, "fx_items")
    c, p = items.alias("c"), items.alias("p")
    return c.join(p, F.col("p.id") == F.col("c.parent")).select("c.id", F.col("p.id").alias("parent_id"), F.col("p.type").alias("parent_type"))


@query(oracle("SELECT id, type, story_id FROM fx_bare WHERE id IN (SELECT parent FROM fx_bare)", "fx_bare"))
def parent_refs(spark, sf_dir):
    bare = frame(spark, sf_dir, "fx_bare")
    return lineage.parent_refs(bare, bare)


@query(oracle("SELECT id, type AS type_, parent, score FROM fx_items WHERE id = 157", "fx_items"))
def scan_item_by_id(spark, sf_dir):
    return frame(spark, sf_dir, "fx_items").filter("id = 157").select("id", F.col("type").alias("type_"), "parent", "score")


@query(oracle("SELECT id, parent, score FROM fx_items WHERE story_id = 150 AND type = 'comment' ORDER BY id", "fx_items"))
def scan_story_comments(spark, sf_dir):
    return frame(spark, sf_dir, "fx_items").filter((F.col("story_id") == 150) & (F.col("type") == "comment")).select("id", "parent", "score").orderBy("id")


@query(oracle("SELECT id, type AS type_, author AS by_, time FROM fx_items", "fx_items"))
def project_alias(spark, sf_dir):
    return frame(spark, sf_dir, "fx_items").select("id", F.col("type").alias("type_"), F.col("author").alias("by_"), "time")


@query(oracle("SELECT id FROM fx_items WHERE type = 'comment' AND NOT (" + HIDDEN + ")", "fx_items"))
def filter_visible(spark, sf_dir):
    own = threads.nodes(frame(spark, sf_dir, "fx_items"), False, False)
    return own.filter("visible").select("id")


ESCAPE = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
AGE = """CASE WHEN {t} IS NULL THEN 'unknown age' WHEN greatest({n} - {t}, 0) < 60 THEN 'just now' WHEN {n} - {t} < 3600 THEN ({n} - {t}) // 60 || CASE WHEN ({n} - {t}) // 60 = 1 THEN ' minute' ELSE ' minutes' END || ' ago'
  WHEN {n} - {t} < 86400 THEN ({n} - {t}) // 3600 || CASE WHEN ({n} - {t}) // 3600 = 1 THEN ' hour' ELSE ' hours' END || ' ago'
  WHEN {n} - {t} <= 2592000 THEN ({n} - {t}) // 86400 || CASE WHEN ({n} - {t}) // 86400 = 1 THEN ' day' ELSE ' days' END || ' ago'
  WHEN {n} - {t} <= 31536000 THEN ({n} - {t}) // 2592000 || CASE WHEN ({n} - {t}) // 2592000 = 1 THEN ' month' ELSE ' months' END || ' ago'
  ELSE ({n} - {t}) // 31536000 || CASE WHEN ({n} - {t}) // 31536000 = 1 THEN ' year' ELSE ' years' END || ' ago' END"""


@query(oracle("SELECT id, " + AGE.format(t="time", n=1181000000) + " AS age FROM (SELECT id, CASE WHEN id % 13 = 5 THEN NULL WHEN id % 3 = 0 THEN 1180999990 - id * 7 ELSE time END AS time FROM fx_items)", "fx_items"))
def relative_age(spark, sf_dir):
    items = frame(spark, sf_dir, "fx_items")
    time = F.when(F.col("id") % 13 == 5, None).when(F.col("id") % 3 == 0, F.lit(1180999990) - F.col("id") * 7).otherwise(F.col("time"))
    return items.select("id", text.relative_age(time, F.lit(1181000000)).alias("age"))


@query(oracle("""WITH n AS (SELECT story_id, count(*) AS n FROM fx_items WHERE type = 'comment' GROUP BY story_id)
SELECT id, '<section class="story"><h1 class="story-title">' || coalesce(""" + ESCAPE.format(x="text") + """, 'Untitled story') || '</h1><p class="story-meta">by ' || coalesce(author, 'unknown') || ' | ' || """ + AGE.format(t="time", n=NOW) + """
  || ' | ' || coalesce(n, 0) || CASE WHEN n = 1 THEN ' comment' ELSE ' comments' END || ' | item ' || id || '</p></section>' || CASE WHEN coalesce(n, 0) = 0 THEN '<p class="empty-thread">No comments yet.</p>' ELSE '' END AS html
FROM fx_items LEFT JOIN n ON n.story_id = id WHERE type = 'story'""", "fx_items"))
def render_story_header(spark, sf_dir):
    items = frame(spark, sf_dir, "fx_items")
    n = items.filter("type = 'comment'").groupBy(F.col("story_id").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    rows = items.filter("type = 'story'").join(n, F.col("id") == F.col("of"), "left")
    html = render.story_header(F.col("id"), F.col("text"), F.col("author"), F.col("time"), F.lit(NOW), F.coalesce("n", F.lit(0).cast("long")), F.lit(0))
    return rows.select("id", html.alias("html"))


MUTED = '<span class="comment-muted">{}</span>'
BODY = "CASE WHEN " + HIDDEN + " THEN '" + MUTED.format("[deleted]") + "' ELSE coalesce(text, '" + MUTED.format("[no text]") + "') END"


@query(oracle("SELECT id, " + BODY + " AS body FROM fx_items WHERE type = 'comment'", "fx_items"))
def render_comment_body(spark, sf_dir):
    return frame(spark, sf_dir, "fx_items").filter("type = 'comment'").select("id", render.comment_body(F.col("deleted"), F.col("dead"), F.col("text")).alias("body"))


BROKEN = """, broken AS (
  SELECT coalesce(c.story_id, k.item) AS story_id, 'MissingChild' AS reason, k.item AS parent_id, k.kid AS child_id FROM fx_kids k JOIN fx_items c ON c.id = k.item
    LEFT JOIN own x ON x.id = k.kid AND x.story_id = c.story_id WHERE x.id IS NULL
  UNION ALL SELECT c.story_id, 'MissingParent', c.parent, c.id FROM own c LEFT JOIN own p ON p.id = c.parent AND p.story_id = c.story_id WHERE p.id IS NULL AND c.parent IS DISTINCT FROM c.story_id
  UNION ALL SELECT t.story_id, 'MissingParent', o.parent, t.id FROM placed t JOIN own o ON o.id = t.id WHERE t.orphan AND o.parent IS NOT NULL AND o.parent <> o.story_id)
"""


def _titled(items):
    """Items with a title, which stories have."""
    return items.withColumn("title", F.when(F.col("type") == "story", F.col("text")))


@query(oracle(TREE.format(hidden="FALSE") + BROKEN + """, nested AS (SELECT *, lead(depth) OVER (PARTITION BY story_id ORDER BY pos) AS nd FROM placed),
body AS (SELECT n.story_id, n.pos, '<article class="comment" id="comment-' || n.id || '"><p class="comment-meta"><span class="comment-author">' || coalesce(author, 'unknown') || '</span> <span class="comment-muted">' || """ + AGE.format(t="time", n=NOW) + """
  || '</span>' || CASE WHEN nd > depth THEN '<button type="button" class="comment-toggle" aria-expanded="true" aria-controls="comment-' || n.id || '-children">[-]</button>' ELSE '' END || '</p><div class="comment-text">' || """ + BODY + """ || '</div>'
  || CASE WHEN nd > depth THEN '<section class="comment-children" id="comment-' || n.id || '-children">' ELSE '</article>' || repeat('</section></article>', CAST(depth - coalesce(nd, 1) AS BIGINT)) END AS html
  FROM nested n JOIN fx_items i ON i.id = n.id),
streams AS (SELECT story_id, string_agg(html, '' ORDER BY pos) AS html, count(*) AS n FROM body GROUP BY story_id), b AS (SELECT story_id, count(*) AS n FROM broken GROUP BY story_id)
SELECT i.id AS story_id, '<section class="story"><h1 class="story-title">' || coalesce(""" + ESCAPE.format(x="i.text") + """, 'Untitled story') || '</h1><p class="story-meta">by ' || coalesce(author, 'unknown') || ' | ' || """ + AGE.format(t="i.time", n=NOW) + """
  || ' | ' || coalesce(s.n, 0) || CASE WHEN s.n = 1 THEN ' comment' ELSE ' comments' END || ' | item ' || i.id || '</p>'
  || CASE WHEN b.n > 0 THEN '<p class="story-meta">' || b.n || CASE WHEN b.n = 1 THEN ' graph break' ELSE ' graph breaks' END || ' detected while reconstructing thread</p>' ELSE '' END || '</section>'
  || CASE WHEN s.n > 0 THEN '<section class="comment-stream">' || s.html || '</section>' ELSE '<p class="empty-thread">No comments yet.</p>' END AS html
FROM fx_items i LEFT JOIN streams s ON s.story_id = i.id LEFT JOIN b ON b.story_id = i.id WHERE i.type = 'story'""", *VIEWS))
def render_thread(spark, sf_dir):
    items, kids = _data(spark, sf_dir)
    return render.thread_fragments(*threads.assemble(items, kids), _titled(items), F.lit(NOW))


ITEM_JSON = "to_json({{'id': {x}.id, 'parent': {x}.parent, 'type_': {x}.type, 'by': {x}.author, 'time': {x}.time, 'text': {x}.text, 'title': CASE WHEN {x}.type = 'story' THEN {x}.text END, 'deleted': {x}.deleted, 'dead': {x}.dead, 'story_id': {x}.story_id}})"


@query(oracle(TREE.format(hidden="FALSE") + BROKEN + """, nested AS (SELECT *, lead(depth) OVER w AS nd, lag(depth) OVER w AS pd FROM placed WINDOW w AS (PARTITION BY story_id ORDER BY pos)),
body AS (SELECT n.story_id, n.pos, CASE WHEN pd >= depth THEN ',' ELSE '' END || '{"item":' || """ + ITEM_JSON.format(x="i") + """ || ',"children":[' || CASE WHEN nd > depth THEN '' ELSE repeat(']}', CAST(depth - coalesce(nd, 1) + 1 AS BIGINT)) END AS piece
  FROM nested n JOIN fx_items i ON i.id = n.id),
r AS (SELECT story_id, string_agg(piece, '' ORDER BY pos) AS roots FROM body GROUP BY story_id),
b AS (SELECT story_id, string_agg(to_json({'reason': reason, 'parent_id': parent_id, 'child_id': child_id}), ',' ORDER BY reason, parent_id, child_id) AS broken FROM broken GROUP BY story_id)
SELECT s.id AS story_id, '{"story":' || """ + ITEM_JSON.format(x="s") + """ || ',"roots":[' || coalesce(roots, '') || '],"graph_breaks":[' || coalesce(broken, '') || ']}' AS json
FROM fx_items s LEFT JOIN r ON r.story_id = s.id LEFT JOIN b ON b.story_id = s.id WHERE s.type = 'story'""", *VIEWS))
def thread_json(spark, sf_dir):
    items, kids = _data(spark, sf_dir)
    return render.thread_json(*threads.assemble(items, kids), _titled(items))


@query(oracle("""WITH roots AS (SELECT id AS story_id FROM fx_items WHERE type = 'story'), comments AS (SELECT id, story_id, parent FROM fx_items WHERE type = 'comment'),
k AS (SELECT item, kid FROM fx_cross),
direct AS (SELECT r.story_id, k.item, k.kid FROM k JOIN roots r ON r.story_id = k.item UNION ALL SELECT c.story_id, k.item, k.kid FROM k JOIN comments c ON c.id = k.item JOIN roots r ON r.story_id = c.story_id),
member AS (SELECT story_id, id FROM comments WHERE story_id IN (SELECT story_id FROM roots) UNION SELECT d.story_id, c.id FROM direct d JOIN comments c ON c.id = d.kid),
known AS (SELECT m.story_id, m.id, c.parent, c.story_id <> m.story_id AS outside FROM member m JOIN comments c ON c.id = m.id WHERE m.id <> m.story_id),
edges AS (SELECT m.story_id, k.item, k.kid FROM k JOIN (SELECT story_id, story_id AS id FROM roots UNION ALL SELECT story_id, id FROM known) m ON m.id = k.item),
judged AS (SELECT e.*, CASE WHEN e.item <> e.story_id AND p.outside THEN 'EdgePointsOutsideStory' WHEN c.id IS NULL THEN 'MissingChild' WHEN c.outside THEN 'EdgePointsOutsideStory' END AS reason
  FROM edges e LEFT JOIN known p ON p.story_id = e.story_id AND p.id = e.item LEFT JOIN known c ON c.story_id = e.story_id AND c.id = e.kid)
SELECT story_id, reason, item AS parent_id, kid AS child_id FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT story_id, 'EdgePointsOutsideStory', parent, id FROM known WHERE outside""", "fx_items", "fx_cross"))
def thread_breaks_linked(spark, sf_dir):
    """Breaks of snapshots that follow edges into other stories, but for missing parents, which thread_breaks has."""
    scratch = Scratch(spark)
    items, kids = scratch.table("items", frame(spark, sf_dir, "fx_items")), scratch.table("kids", frame(spark, sf_dir, "fx_cross"))
    return threads.assemble(items, kids, members=threads.linked_members(items, kids))[1].filter("reason <> 'MissingParent'")
