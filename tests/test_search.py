"""The lexer of search vectors, and the index of their tokens."""

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.functions import search
from threadloom.operators import postings
from threadloom.plans import registry


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), ("Show HN: A Thing", ["show", "hn", "a", "thing"]),
        ("http://Example.com/stuff/index.html?q=1#x", ["example.com/stuff/index.html?q=1#x", "example.com", "/stuff/index.html?q=1#x"]),
        ("see www.a-b.co.uk:8080 now", ["see", "www.a-b.co.uk:8080", "now"]), ("https://host.org/", ["host.org/", "host.org", "/"]),
        ("state-of-the-art 2nd", ["state-of-the-art", "state", "of", "the", "art", "2nd"]), ("up-to-date!", ["up-to-date", "up", "to", "date"]),
        ("mail me@x.org, 3.14 -5 2024-01-02", ["mail", "me@x.org", "3.14", "-5", "2024", "-01", "-02"]), ("<b class=x>bold</b> &amp; &#39;q&#39;", ["bold", "q"]),
        ("École 漢字 o'neil a_b", ["école", "漢字", "o", "neil", "a", "b"]), ("- -- / . ...", []),
    ],
)
def test_lexemes(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(search.lexemes(F.col("t"))).first()[0] == expected


def test_vector_text(spark):
    rows = spark.createDataFrame([("The cat, the hat", "http://the.cat"), ("it's", None), (None, None)], "title string, url string")
    got = [r[0] for r in rows.select(search.search_tokens(F.col("title"), F.col("url")).alias("t")).select(search.vector_text(F.col("t"))).collect()]
    assert got == ["'cat':2A 'hat':4A 'the':1A,3A 'the.cat':5B", "'it':1A 's':2A", ""]


def test_positions_end(spark):
    got = spark.createDataFrame([("w " * 16_390, "a.bc")], "title string, url string").select(F.array_max(F.transform(search.search_tokens(F.col("title"), F.col("url")), lambda x: x["pos"]))).first()[0]
    assert got == search.LAST_POSITION


def test_the_index_answers_what_a_scan_does(spark, tmp_path):
    rows = [(k, f"common {'rare' if k % 50 == 7 else 'plain'} n{k}", f"http://site{k % 3}.org/p{k}") for k in range(600)]
    items = spark.createDataFrame(rows, "id long, title string, url string")
    postings.build(items, str(tmp_path / "index"))
    ask = lambda *tokens, **more: sorted(r["id"] for r in postings.search(spark, str(tmp_path / "index"), tokens, **more).collect())
    assert ask("rare") == list(range(7, 600, 50)) and ask("Rare", "site1.org") == [k for k in range(7, 600, 50) if k % 3 == 1]
    assert ask("common") == list(range(600)) and ask("common", weight="B") == [] and ask("n5", "n6") == [] and ask("absent") == []
    plan = postings.search(spark, str(tmp_path / "index"), ["rare"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,rare)]" in plan or "In(token, [rare])" in plan


@pytest.mark.parametrize("name", ["search_vector", "search_postings"])
def test_places_past_the_last_position_are_each_listed_as_in_sql(spark, tmp_path, name):
    """The URL's tokens differ from the text's: of one token at the last position under both weights, the SQL leaves the order open."""
    pages = spark.createDataFrame([(1, "the that " * 8_200, "http://www.therst.example.com/x"), (2, "the that o'neil", None), (3, None, None)], "page_id long, html string, url string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(repr, connection.sql(registry.ORACLES[name]).fetchall()))
    assert name != "search_vector" or any(row.count("16383A") == 18 for row in got)
