"""HTML fragments of threads, from columns. ``now`` is a parameter.

Fixed values: the wording, class names and element ids below are the markup that pages and style sheets expect; they are stated as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text


def story_header(story_id: Column, title: Column, author: Column, time: Column, now: Column, n_comments: Column, n_breaks: Column) -> Column:
    meta = F.concat(F.lit("by "), text.escape_html(F.coalesce(author, F.lit("unknown"))), F.lit(" | "), text.escape_html(text.relative_age(time, now)), F.lit(" | "), text.plural(n_comments, "comment"), F.lit(" | item "), story_id.cast("string"))
    broken = F.when(n_breaks > 0, F.concat(F.lit('<p class="story-meta">'), text.plural(n_breaks, "graph break"), F.lit(" detected while reconstructing thread</p>"))).otherwise("")
    head = F.concat(F.lit('<section class="story"><h1 class="story-title">'), text.escape_html(F.coalesce(title, F.lit("Untitled story"))), F.lit('</h1><p class="story-meta">'), meta, F.lit("</p>"), broken, F.lit("</section>"))
    return F.concat(head, F.when(n_comments == 0, F.lit('<p class="empty-thread">No comments yet.</p>')).otherwise(""))


def comment_body(deleted: Column, dead: Column, body: Column) -> Column:
    """Bodies are stored HTML and stay as they are; hidden and absent ones show a mark."""
    hidden = F.coalesce(deleted, F.lit(False)) | F.coalesce(dead, F.lit(False))
    return F.when(hidden, F.lit('<span class="comment-muted">[deleted]</span>')).otherwise(F.coalesce(body, F.lit('<span class="comment-muted">[no text]</span>')))


def error_fragment(story_id: Column, message: Column) -> Column:
    return F.concat(F.lit('<div class="thread-error">Could not load story '), story_id.cast("string"), F.lit(": "), text.escape_html(message), F.lit("</div>"))


def in_context(tree: DataFrame) -> DataFrame:
    """Adds the depths of the rows before and after in depth-first order, null at a story's ends. Joins by place: a story of any length is many tasks."""
    at = lambda name, by: tree.select("story_id", (F.col("pos") + by).alias("pos"), F.col("depth").alias(name))
    return tree.join(at("before", 1), ["story_id", "pos"], "left").join(at("after", -1), ["story_id", "pos"], "left")


JOINED = 1000


def joined(pieces: DataFrame) -> DataFrame:
    """(story_id, whole) of pieces (story_id, pos, piece) in order: first of stretches of ``JOINED`` pieces, then of the stretches."""
    in_order = lambda place, piece: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, piece))), lambda x: x[piece]), "")
    stretches = pieces.groupBy("story_id", F.floor(F.col("pos") / JOINED).alias("stretch")).agg(in_order("pos", "piece").alias("part"))
    return stretches.groupBy("story_id").agg(in_order("stretch", "part").alias("whole"))


def thread_pieces(tree: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """(story_id, pos, piece): what each comment adds to its story's HTML. Depth-first rows carry what recursion would: a deeper next row opens a list of
    children, a shallower one closes as many as it is shallower."""
    rows = in_context(tree.select("story_id", "id", "depth", "pos"))
    parent = F.coalesce(F.col("after") > F.col("depth"), F.lit(False))
    own = F.concat(F.lit("comment-"), F.col("id").cast("string"))
    toggle = F.concat(F.lit('<button type="button" class="comment-toggle" aria-expanded="true" aria-controls="'), own, F.lit('-children">[-]</button>'))
    piece = F.concat(
        F.lit('<article class="comment" id="'), own, F.lit('"><p class="comment-meta"><span class="comment-author">'), text.escape_html(F.coalesce("author", F.lit("unknown"))),
        F.lit('</span> <span class="comment-muted">'), text.escape_html(text.relative_age(F.col("time"), now)), F.lit("</span>"), F.when(parent, toggle).otherwise(""),
        F.lit('</p><div class="comment-text">'), comment_body(F.col("deleted"), F.col("dead"), F.col("text")), F.lit("</div>"),
        F.when(parent, F.concat(F.lit('<section class="comment-children" id="'), own, F.lit('-children">')))
        .otherwise(F.concat(F.lit("</article>"), F.repeat(F.lit("</section></article>"), F.col("depth") - F.coalesce("after", F.lit(1))))),
    )
    return rows.join(items.select("id", "author", "time", "deleted", "dead", "text"), "id").select("story_id", "pos", piece.alias("piece"))


def thread_fragments(tree: DataFrame, breaks: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """(story_id, html) of every story: its header, and its comments, nested, if it has any."""
    counted = lambda df, name: df.groupBy("story_id").agg(F.count(F.lit(1)).alias(name))
    heads = items.filter("type = 'story'").select(F.col("id").alias("story_id"), "title", "author", "time")
    heads = heads.join(counted(tree, "n_comments"), "story_id", "left").join(counted(breaks, "n_breaks"), "story_id", "left").join(joined(thread_pieces(tree, items, now)), "story_id", "left")
    zero = F.lit(0).cast("long")
    head = story_header(F.col("story_id"), F.col("title"), F.col("author"), F.col("time"), now, F.coalesce("n_comments", zero), F.coalesce("n_breaks", zero))
    stream = F.coalesce(F.concat(F.lit('<section class="comment-stream">'), F.col("whole"), F.lit("</section>")), F.lit(""))
    return heads.select("story_id", F.concat(head, stream).alias("html"))


#: Fields of an item in a thread's JSON, in order, and the columns that they come from.
ITEM_FIELDS = {"id": "id", "parent": "parent", "type_": "type", "by": "author", "time": "time", "text": "text", "title": "title", "deleted": "deleted", "dead": "dead", "story_id": "story_id"}


def _item_json(columns: list[str]) -> Column:
    fields = [(F.col(c) if c in columns else F.lit(None).cast("string")).alias(name) for name, c in ITEM_FIELDS.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def thread_json(tree: DataFrame, breaks: DataFrame, items: DataFrame) -> DataFrame:
    """(story_id, json) of every story: ``{"story", "roots": [{"item", "children": [...]}], "graph_breaks"}``, breaks in the order of their fields."""
    made = items.select("id", _item_json(items.columns).alias("item"))
    rows = in_context(tree.select("story_id", "id", "depth", "pos")).join(made, "id")
    parent = F.coalesce(F.col("after") > F.col("depth"), F.lit(False))
    comma = F.when(F.col("before") >= F.col("depth"), ",").otherwise("")
    piece = F.concat(comma, F.lit('{"item":'), F.col("item"), F.lit(',"children":['), F.when(parent, "").otherwise(F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("after", F.lit(1)) + 1)))
    roots = joined(rows.select("story_id", "pos", piece.alias("piece")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("reason", "parent_id", "child_id"))), lambda x: F.to_json(x, {"ignoreNullFields": "false"}))
    broken = breaks.groupBy("story_id").agg(F.array_join(listed, ",").alias("broken"))
    stories = items.filter("type = 'story'").select(F.col("id").alias("story_id"), _item_json(items.columns).alias("story"))
    whole = F.concat(F.lit('{"story":'), F.col("story"), F.lit(',"roots":['), F.coalesce("whole", F.lit("")), F.lit('],"graph_breaks":['), F.coalesce("broken", F.lit("")), F.lit("]}"))
    return stories.join(roots, "story_id", "left").join(broken, "story_id", "left").select("story_id", whole.alias("json"))
