"""Explorer sources, titles, judge texts and small rules at their edges."""

from pyspark.sql import functions as F

from quarry.operators import explorer, reports


def test_explorer_blocks(spark):
    block = lambda n, doc: f"***Web Page {n}:***\n{doc}\n"
    given = block(1, '{"title":"a","url":"u1","snippet":"s1","page_info":"' + "p" * 3000 + '"\n}') + block(2, '{"title":null,"url":"u2"\n}') + block(1, '{"title":"b","url":"u3","snippet":"s3"\n}') + block(5, '{"x":\n}')
    rows = [(0, 0, given, "Web Page 2, and 7", "q"), (0, 1, given, "none", None), (0, 2, None, "Web Page 1", "q"), (0, 3, "no block", None, "q"), (1, 0, block(1, '{"title":"t","page_info":"' + "p" * 3000 + '"\n}'), "web pages 1-1", "q")]
    calls = spark.createDataFrame(rows, "trace int, call int, input string, extracted string, search_query string")
    found = {(r.trace, r.call, r.page): r for r in explorer.explorer_sources(calls, "trace", "call").collect()}
    assert sorted(found) == [(0, 0, "1"), (0, 0, "2"), (0, 1, "1"), (0, 1, "2"), (1, 0, "1")]
    assert (found[0, 0, "1"].title, found[0, 0, "1"].place, found[0, 0, "1"].selected) == ("b", 0, False)
    assert (found[0, 0, "2"].title, found[0, 0, "2"].snippet, found[0, 0, "2"].selected) == ("(untitled)", "", True)
    assert all(found[0, 1, p].selected and not found[0, 1, p].backref for p in "12")
    assert len(found[1, 0, "1"].snippet) == explorer.PAGE_CHARS


def test_judge_text_edges(spark):
    kind = "a string, d array<struct<id:string,title:string,url:string,snippet:string>>"
    rows = [(None, []), ("plain", []), ('<cite id="x">c</cite>', []), ('<cite id="x y">c</cite>', [("x", "T", "", "one two three"), ("y", "U", "u", "")])]
    told = [r.t for r in spark.createDataFrame(rows, kind).select(explorer.judge_text(F.col("a"), F.col("d"), F.col("d"), 2).alias("t")).collect()]
    assert [(t.text, t.inline) for t in told[:3]] == [("", False), ("plain", False), ("c", True)]
    assert told[3].text == "c [1][2]\n\nReferences\n[1] T\n    snippet: one two …\n\n[2] U — u"


def test_phrases_and_buckets(spark):
    rows = spark.createDataFrame([(["A", " ", "a ", "b", "c", "d"],), ([],)], "p array<string>")
    assert [r.f for r in rows.select(reports.searched_phrases(F.col("p"), 4).alias("f")).collect()] == [["A", "b", "c"], []]
    told = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), (None, 4), (None, 0)], "b string, o int")
    assert [(r.place, r.bucket, r.n, r.example) for r in reports.buckets(told, F.col("b"), "o", "o", 2).orderBy("place").collect()] == [(1, None, 2, 0), (2, "x", 2, 1)]
