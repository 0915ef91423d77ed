"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import classify, search, sizing, text
from threadloom.operators import jsonwalk, postings, render
from threadloom.plans.fixtures import frame, oracle
from threadloom.plans.registry import query
from threadloom.sources.scratch import Scratch


@query(rf"SELECT page_id, CASE WHEN trim(url) <> '' THEN nullif(lower(regexp_extract(url, '{text.DOMAIN_PATTERN}', 1)), '') END AS domain FROM pages")
def url_domain(spark, sf_dir):
    return frame(spark, sf_dir, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@query("SELECT event_id, CAST(to_timestamp((event_id - 500) * 40000 + 11) AS DATE) AS day FROM events")
def item_day(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", text.item_day((F.col("event_id") - 500) * 40000 + 11).alias("day"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(0) || text ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 'a' || chr(0) || 'b' ELSE source END AS title FROM documents)
SELECT doc_id, length(replace(text, chr(0), '')) AS n, replace(title, chr(0), '') AS title, concat_ws(',', CASE WHEN contains(text, chr(0)) THEN 'text' END, CASE WHEN contains(title, chr(0)) THEN 'title' END) AS changed FROM d""")
def strip_nul(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("a\0b")).otherwise(F.col("source")).alias("title"))
    changed = F.array_join(text.nul_fields({"text": F.col("text"), "title": F.col("title")}), ",")
    return docs.select("doc_id", F.length(text.strip_nul(F.col("text"))).cast("long").alias("n"), text.strip_nul(F.col("title")).alias("title"), changed.alias("changed"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return frame(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'abc' || chr(0) || chr(7) WHEN 1 THEN 'a' || chr(27) || 'b' WHEN 2 THEN 'a' || chr(9) || 'b' || chr(10) || chr(13) ELSE text END AS v FROM documents),
f AS (SELECT doc_id, v, regexp_extract(v, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS c FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN contains(v, chr(0)) THEN 'contains NUL byte' END,
  CASE WHEN c <> '' THEN 'contains control char U+' || format('{:04X}', unicode(c)) || ' at char index ' || (strpos(v, c) - 1) END) AS issues FROM f""")
def string_issues(spark, sf_dir):
    kind = F.col("doc_id") % 4
    value = F.when(kind == 0, F.lit("abc\0\x07")).when(kind == 1, F.lit("a\x1bb")).when(kind == 2, F.lit("a\tb\n\r")).otherwise(F.col("text"))
    return frame(spark, sf_dir, "documents").withColumn("value", value).select("doc_id", F.array_join(text.control_issue(F.col("value")), ",").alias("issues"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'NULL' ELSE '''' || replace(source || '''s', '''', '''''') || '''' END AS quoted FROM documents")
def sql_quote(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", text.sql_quote(F.when(F.col("doc_id") % 7 != 0, F.concat(F.col("source"), F.lit("'s")))).alias("quoted"))


@query("SELECT event_id, 'http://host/v0/item/' || event_id || '.json' AS url FROM events")
def item_url(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", text.item_url(F.lit("http://host/v0//"), F.col("event_id")).alias("url"))


def _lexed(column: str) -> str:
    """DuckDB's lexemes of a column."""
    host, url = search.HOST, f"{search.HOST}{search.PATH}"
    return f"""flatten(list_transform(list_filter(regexp_extract_all(lower(coalesce({column}, '')), '{search.TOKEN}'), lambda x: NOT regexp_matches(x, '{search.PASSED}')), lambda x:
      CASE WHEN regexp_full_match(x, '{url}') THEN [x, regexp_extract(x, '^{host}'), regexp_replace(x, '^{host}', '')] WHEN regexp_full_match(x, '{search.COMPOUND}') THEN list_concat([x], string_split(x, '-')) ELSE [x] END))"""


LEXED = f"""WITH p AS (SELECT page_id, {_lexed("html")} AS a, {_lexed("url")} AS b FROM pages),
t AS (SELECT page_id, unnest(a) AS token, 'A' AS weight, generate_subscripts(a, 1) AS pos FROM p UNION ALL SELECT page_id, unnest(b), 'B', generate_subscripts(b, 1) + len(a) FROM p),
v AS (SELECT page_id, token, weight, CAST(least(pos, 16383) AS BIGINT) AS pos FROM t)
"""


@query(LEXED + "SELECT page_id, token, weight, pos FROM v")
def search_tokens(spark, sf_dir):
    rows = frame(spark, sf_dir, "pages").select("page_id", F.inline(search.search_tokens(F.col("html"), F.col("url"))))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(LEXED + """, w AS (SELECT page_id, token, string_agg(pos || weight, ',' ORDER BY pos) AS places FROM v GROUP BY page_id, token)
SELECT p.page_id, coalesce(string_agg('''' || replace(token, '''', '''''') || ''':' || places, ' ' ORDER BY encode(token)), '') AS vector FROM p LEFT JOIN w USING (page_id) GROUP BY p.page_id""")
def search_vector(spark, sf_dir):
    tokens = search.search_tokens(F.col("html"), F.col("url"))
    return frame(spark, sf_dir, "pages").select("page_id", tokens.alias("tokens")).select("page_id", search.vector_text(F.col("tokens")).alias("vector"))


@query(LEXED + """, one AS (SELECT page_id, count(*) AS n FROM v WHERE token = 'the' AND weight = 'A' GROUP BY 1), two AS (SELECT page_id, count(*) AS n FROM v WHERE token = 'that' AND weight = 'A' GROUP BY 1)
SELECT 'the that' AS asked, page_id AS id, one.n + two.n AS n_places FROM one JOIN two USING (page_id) UNION ALL SELECT 'host', page_id, count(*) FROM v WHERE token = 'www.therst.example.com' GROUP BY page_id""")
def search_postings(spark, sf_dir):
    """Titles with two words, and URLs of a host, from the index of all pages."""
    path = Scratch(spark).path("index")
    postings.build(frame(spark, sf_dir, "pages").withColumnRenamed("page_id", "id"), path, title="html")
    asked = {"the that": postings.search(spark, path, ["The", "that"], "A"), "host": postings.search(spark, path, ["www.therst.example.com"])}
    one, two = (found.select(F.lit(name).alias("asked"), "id", F.col("n_places").cast("long").alias("n_places")) for name, found in asked.items())
    return one.unionByName(two)


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || event_id || ', 2]' WHEN 1 THEN '{' || event_id || ',3}' WHEN 2 THEN event_id || ' , 4' WHEN 3 THEN '  ' ELSE '{}' END AS raw FROM events)
SELECT event_id, CASE WHEN trim(raw) <> '' THEN array_to_string(list_transform(list_filter(string_split(translate(raw, '[]{}', ''), ','), lambda x: trim(x) <> ''), lambda x: CAST(CAST(trim(x) AS BIGINT) AS VARCHAR)), ',') END AS parts FROM r""")
def parse_parts(spark, sf_dir):
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.concat(F.lit("["), n, F.lit(", 2]"))).when(kind == 1, F.concat(F.lit("{"), n, F.lit(",3}"))).when(kind == 2, F.concat(n, F.lit(" , 4"))).when(kind == 3, F.lit("  ")).otherwise(F.lit("{}"))
    parsed = F.transform(text.parse_parts(F.col("raw")), lambda x: x.cast("string"))
    return frame(spark, sf_dir, "events").withColumn("raw", raw).select("event_id", F.array_join(parsed, ",").alias("parts"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{' || event_id || ',7}' WHEN 1 THEN '{}' END AS parts FROM events")
def format_parts(spark, sf_dir):
    kind = F.col("event_id") % 3
    parts = F.when(kind == 0, F.array(F.col("event_id"), F.lit(7).cast("long"))).when(kind == 1, F.array().cast("array<bigint>"))
    return frame(spark, sf_dir, "events").select("event_id", text.format_parts(F.transform(parts, lambda x: x.cast("string"))).alias("parts"))


@query(oracle("""SELECT item_id, CASE WHEN status = 200 THEN NULL WHEN status = 401 THEN 'Unauthorized' WHEN status = 403 THEN 'Forbidden' WHEN status = 429 THEN 'RateLimited' WHEN status >= 500 THEN 'UpstreamUnavailable' ELSE 'Other' END AS kind,
  CASE WHEN status = 200 THEN NULL WHEN status = 429 OR status >= 500 THEN 'network_transient' WHEN status >= 400 THEN 'http_4xx' ELSE 'schema' END AS failure_class, coalesce(status = 429 OR status >= 500, FALSE) AS retryable FROM fx_http""", "fx_http"))
def classify_status(spark, sf_dir):
    kind = classify.status_kind(F.col("status"))
    return frame(spark, sf_dir, "fx_http").select("item_id", kind.alias("kind"), classify.status_class(F.col("status")).alias("failure_class"), F.coalesce(classify.is_retryable(kind), F.lit(False)).alias("retryable"))


@query("""WITH e AS (SELECT event_id AS id, event_id % 2 = 1 AS a, event_id % 3 = 1 AS d, CASE WHEN event_id % 5 = 0 THEN 503 WHEN event_id % 7 = 0 THEN 404 END AS status FROM events)
SELECT id, CASE WHEN status = 503 THEN 'UpstreamUnavailable' WHEN status = 404 THEN 'Other' WHEN a OR d THEN 'Network' ELSE 'MalformedResponse' END AS kind,
  CASE WHEN status = 503 THEN 'network_transient' WHEN status = 404 THEN 'http_4xx' WHEN a THEN 'network_transient' WHEN d THEN 'decode' ELSE 'schema' END AS failure_class FROM e""")
def classify_transport(spark, sf_dir):
    i, no = F.col("event_id"), F.lit(False)
    flags = {"timeout": i % 2 == 1, "connect": no, "request": no, "body": no, "decode": i % 3 == 1}
    status = F.when(i % 5 == 0, 503).when(i % 7 == 0, 404)
    return frame(spark, sf_dir, "events").select(i.alias("id"), classify.transport_kind(flags, status).alias("kind"), classify.transport_class(flags, status).alias("failure_class"))


def _named(names):
    return F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))


def _listed(names) -> str:
    """The same for DuckDB."""
    return f"([{', '.join(repr(x) for x in names)}])[event_id % {len(names)} + 1]"


DB_ERRORS = (*classify.RETRYABLE_DB, "UniqueViolation")
MESSAGES = ("Statement TIMEOUT", "Broken pipe (os error 32)", "server closed the Connection", "syntax error", "temporarily out of memory", "connect failed")


@query(f"""SELECT event_id, CASE WHEN {_listed(DB_ERRORS)} IN ('SerializationFailure', 'ClosedConnection', 'UnableToSendCommand', 'RollbackTransaction') THEN 'retryable' ELSE 'fatal' END AS outcome FROM events""")
def classify_persist_error(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", classify.persist_outcome(_named(DB_ERRORS)).alias("outcome"))


@query(f"""SELECT event_id, CASE WHEN regexp_matches(lower({_listed(MESSAGES)}), 'timeout|temporar|deadlock|connection reset|broken pipe|connection') THEN 'transient' ELSE 'permanent' END AS outcome FROM events""")
def classify_backend_error(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", classify.backend_outcome(_named(MESSAGES)).alias("outcome"))


@query("SELECT event_id, CAST([404, 404, 503, 500, 503, 200][event_id % 6 + 1] AS INT) AS status FROM events")
def tree_status(spark, sf_dir):
    error = F.nullif(_named(("not_found", "not_a_story", "transient", "permanent", "pool", "")), F.lit(""))
    return frame(spark, sf_dir, "events").select("event_id", classify.tree_http_status(error).alias("status"))


@query("SELECT event_id, least(250 * CAST(pow(2, least(event_id % 40, 20)) AS BIGINT), 60000) AS delay FROM events")
def backoff_delay(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", sizing.backoff_ms(250, 60000, F.col("event_id") % 40 + 1).alias("delay"))


def _mix(x: str, factor: str) -> str:
    return f"CAST((xor({x}, {x} // 8589934592)::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


@query(f"""WITH a AS (SELECT event_id, xor(event_id::UBIGINT, CAST(((event_id % 6 + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)) AS x FROM events),
b AS (SELECT event_id, {_mix('x', '18397679294719823053')} AS x FROM a), c AS (SELECT event_id, {_mix('x', '14181476777654086739')} AS x FROM b)
SELECT event_id, CAST(xor(x, x // 8589934592) % 251 AS BIGINT) AS delay FROM c""")
def jitter(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", sizing.jitter(250)(F.col("event_id"), F.col("event_id") % 6 + 1).alias("delay"))


@query(oracle(f"""WITH a AS (SELECT segment_id, item_id, attempts, xor(item_id::UBIGINT, CAST((greatest(attempts, 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)) AS x FROM fx_exceptions),
b AS (SELECT * EXCLUDE (x), {_mix('x', '18397679294719823053')} AS x FROM a), c AS (SELECT * EXCLUDE (x), {_mix('x', '14181476777654086739')} AS x FROM b)
SELECT segment_id, item_id, least(250 * CAST(pow(2, greatest(attempts, 1) - 1) AS BIGINT), 1500) + CAST(xor(x, x // 8589934592) % 101 AS BIGINT) AS delay FROM c""", "fx_exceptions"))
def retry_delay(spark, sf_dir):
    delay = sizing.retry_delay_ms(250, 1500, 100, F.col("item_id"), F.greatest("attempts", F.lit(1)))
    return frame(spark, sf_dir, "fx_exceptions").select("segment_id", "item_id", delay.alias("delay"))


@query(oracle("SELECT segment_id, CAST(least(greatest(end_id - coalesce(scan_cursor_id + 1, start_id) + 1, 0), 2147483647) AS INT) AS n FROM fx_segments", "fx_segments"))
def unresolved_count(spark, sf_dir):
    return frame(spark, sf_dir, "fx_segments").select("segment_id", sizing.unresolved_count(F.col("start_id"), F.col("end_id"), F.col("scan_cursor_id")).alias("n"))


CASES = """WITH e AS (SELECT event_id AS id, 5000 AS m, event_id % 6000 AS f, CASE WHEN event_id % 3 = 1 THEN event_id % 70 + 1 END AS cold, CASE WHEN event_id % 4 = 1 THEN event_id % 900 + 1 END AS lim,
  CASE WHEN event_id % 4 = 2 THEN event_id % 8000 + 1 END AS e, event_id % 2 = 0 AS ign FROM events)
"""


def _cases(spark, sf_dir):
    i = F.col("event_id")
    long = lambda c: c.cast("long")
    return frame(spark, sf_dir, "events").select(i.alias("id"), long(F.lit(5000)).alias("m"), (i % 6000).alias("f"), F.when(i % 3 == 1, i % 70 + 1).alias("cold"), F.when(i % 4 == 1, i % 900 + 1).alias("lim"), F.when(i % 4 == 2, i % 8000 + 1).alias("e"), (i % 2 == 0).alias("ign"))


@query(CASES + """, t AS (SELECT id, coalesce(cold, f + 1) AS s, CASE WHEN e IS NOT NULL THEN CASE WHEN ign THEN e ELSE least(e, m) END WHEN lim IS NOT NULL THEN CASE WHEN ign THEN coalesce(cold, f + 1) + lim - 1 ELSE least(coalesce(cold, f + 1) + lim - 1, m) END ELSE m END AS target FROM e)
SELECT id, target, greatest(target - s + 1, 0) AS total FROM t""")
def target_window(spark, sf_dir):
    c = F.col
    rows = _cases(spark, sf_dir).withColumn("target", sizing.target_max(c("m"), c("f"), c("cold"), c("lim"), c("e"), c("ign")))
    return rows.select("id", "target", sizing.target_total(F.coalesce("cold", c("f") + 1), c("target")).alias("total"))


@query(CASES + "SELECT id, CASE WHEN lim IS NULL AND e IS NULL AND coalesce(cold, f + 1) <= 1 THEN 'full_history' WHEN lim IS NULL AND e IS NULL AND cold IS NULL THEN 'updater' ELSE 'bounded' END AS profile FROM e")
def target_profile(spark, sf_dir):
    c = F.col
    return _cases(spark, sf_dir).select("id", sizing.target_profile(c("lim"), c("cold"), c("e"), F.coalesce("cold", c("f") + 1)).alias("profile"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 100 ELSE least(event_id % 77, event_id % 50) * 100 // (event_id % 50) END AS percent FROM events")
def progress_percent(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", sizing.percent_complete(F.col("event_id") % 77, F.col("event_id") % 50).alias("percent"))


@query(oracle("SELECT segment_id, greatest(coalesce(end_id - 5 - coalesce(scan_cursor_id + 1, start_id) + 1, 0), 0) AS n FROM fx_segments", "fx_segments"))
def durable_advance(spark, sf_dir):
    return frame(spark, sf_dir, "fx_segments").select("segment_id", sizing.durable_advance(sizing.next_id(F.col("start_id"), F.col("scan_cursor_id")), F.col("end_id") - 5).alias("n"))


@query("""WITH w AS (SELECT event_id, greatest((greatest(((event_id % 4000) * 50 + 999) // 1000, 1) * 9 + 4) // 5, 1) AS workers FROM events)
SELECT event_id, workers, greatest(workers * 2, 1) AS queue, greatest(least(workers, 64), 1) AS pool FROM w""")
def derive_workers(spark, sf_dir):
    rows = frame(spark, sf_dir, "events").select("event_id", sizing.derive_workers(F.col("event_id") % 4000).alias("workers"))
    return rows.select("event_id", "workers", sizing.queue_capacity(F.col("workers")).alias("queue"), sizing.pool_size(F.col("workers")).cast("long").alias("pool"))


@query("SELECT event_id, CASE WHEN event_id % 10 < 9 THEN round(event_id * (1 - (event_id % 10 + 1) / 10.0::DOUBLE) / ((event_id % 10 + 1) / 10.0::DOUBLE), 6) END AS pause FROM events")
def throttle_pause(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", F.round(sizing.throttle_pause(F.col("event_id"), (F.col("event_id") % 10 + 1) / F.lit(10.0)), 6).alias("pause"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE left(md5(CAST(doc_id AS VARCHAR)), 12) END AS commit FROM documents")
def short_hash(spark, sf_dir):
    commit = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.md5(F.col("doc_id").cast("string").cast("binary")))
    return frame(spark, sf_dir, "documents").select("doc_id", text.short_hash(commit).alias("commit"))


@query("SELECT event_id, event_type || CASE WHEN event_id % 3 > 0 THEN ' | caused_by: user ' || user_id ELSE '' END || CASE WHEN event_id % 3 = 2 THEN ' | caused_by: end' ELSE '' END AS message FROM events")
def error_chain(spark, sf_dir):
    causes = F.slice(F.array("event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("end")), F.lit(1), (F.col("event_id") % 3 + 1).cast("int"))
    return frame(spark, sf_dir, "events").select("event_id", text.error_chain(causes).alias("message"))


@query("SELECT event_id, event_type || '-' || user_id || '-' || (event_id * 1000 + 7) AS run_id FROM events")
def run_id(spark, sf_dir):
    return frame(spark, sf_dir, "events").select("event_id", text.run_id(F.col("event_type"), F.col("user_id"), F.col("event_id") * 1000 + 7).alias("run_id"))


@query("""SELECT page_id, md5('<div class="thread-error">Could not load story ' || page_id || ': ' || replace(replace(replace(replace(replace(coalesce(url, '') || ' <"missing" & ' || chr(39) || 'gone' || chr(39) || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '</div>') AS html FROM pages""")
def render_error(spark, sf_dir):
    message = F.concat(F.coalesce("url", F.lit("")), F.lit(" <\"missing\" & 'gone'>"))
    return frame(spark, sf_dir, "pages").select("page_id", F.md5(render.error_fragment(F.col("page_id"), message).cast("binary")).alias("html"))


@query("""SELECT event_id, '{"a":[' || event_id || ',{"x":null,"y":true}],"b":{"c":"' || event_type || '","d":' || user_id || '}}' AS rendered FROM events""")
def sorted_json(spark, sf_dir):
    raw = F.format_string('{"b": {"d": %d, "c": "%s"}, "a": [%d, {"y": true, "x": null}]}', "user_id", "event_type", "event_id")
    return frame(spark, sf_dir, "events").select("event_id", text.sorted_json(raw).alias("rendered"))


@query("""SELECT event_id, '{' || chr(10) || '  "a": [' || chr(10) || '    ' || event_id || ',' || chr(10) || '    {' || chr(10) || '      "x": null,' || chr(10) || '      "y": []' || chr(10) || '    }' || chr(10) || '  ],' || chr(10)
  || '  "b": {' || chr(10) || '    "c": "' || event_type || ': [1,{2}]",' || chr(10) || '    "d": ' || user_id || chr(10) || '  }' || chr(10) || '}' AS rendered FROM events""")
def pretty_json(spark, sf_dir):
    raw = F.format_string('{"b": {"d": %d, "c": "%s: [1,{2}]"}, "a": [%d, {"y": [], "x": null}]}', "user_id", "event_type", "event_id")
    return frame(spark, sf_dir, "events").select("event_id", text.pretty_json(raw).alias("rendered"))


@query(r"""WITH d AS (SELECT event_id, '{"a":{"b":["' || event_type || '","x\u001by",' || user_id || ',{"deep":[["\u0007"]]}]},"c":"' || CASE WHEN event_id % 2 = 0 THEN '\u0001' ELSE 'fine\n' END || '"}' AS j FROM events),
t AS (SELECT event_id, x.fullkey AS path, x.atom ->> '$' AS v FROM d, json_tree(d.j) AS x WHERE x.type = 'VARCHAR')
SELECT event_id, path, CASE v WHEN 'x' || chr(27) || 'y' THEN 'contains control char U+001B at char index 1' WHEN chr(7) THEN 'contains control char U+0007 at char index 0' ELSE 'contains control char U+0001 at char index 0' END AS issue
FROM t WHERE regexp_matches(v, '[\x00-\x08\x0b\x0c\x0e-\x1f]')""")
def json_string_issues(spark, sf_dir):
    last = F.when(F.col("event_id") % 2 == 0, r"\u0001").otherwise(r"fine\n")
    raw = F.concat(F.lit('{"a":{"b":["'), "event_type", F.lit(r'","x\u001by",'), F.col("user_id").cast("string"), F.lit(r',{"deep":[["\u0007"]]}]},"c":"'), last, F.lit('"}'))
    found = jsonwalk.json_strings(frame(spark, sf_dir, "events").select("event_id", raw.alias("raw")), ["event_id"], "raw")
    return found.select("event_id", "path", F.explode(text.control_issue(F.col("value"))).alias("issue"))
