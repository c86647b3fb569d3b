"""Citations and mentions: every text is searched once for each pattern, and read once."""

from pyspark.sql import functions as F

from foliograph.functions import patterns
from foliograph.operators import citations as C


def test_matches_have_their_places_whatever_signs_a_text_has(spark):
    texts = ["", "\x01", "Fig. 1\x01 and \x02fig 2", "\x01\x01§ 3.1, Table 4", "[1]\x01[2–4]", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    found = {(r.k, r.kind, r.begin, r.length, r.target) for r in C.mentions(rows, ["k"]).collect()}
    assert found == {(2, "figure", 0, 6, "1"), (2, "figure", 13, 5, "2"), (3, "sectionMark", 2, 5, "3.1"), (3, "table", 9, 7, "4")}
    assert {(r.k, r.begin, r.content) for r in C.citations(rows, ["k"]).collect()} == {(4, 0, "1"), (4, 4, "2–4")}


def test_a_text_is_searched_once_for_a_pattern(spark):
    rows = spark.createDataFrame([(1, 2, "Figure 3: x"), (1, 3, "Table 3 x"), (1, 4, "x")], "doc_id long, line_no int, text string")
    found = C.captions(rows)
    assert {(r.kind, r.target, r.line_no) for r in found.collect()} == {("figure", "3", 2), ("table", "3", 3)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == len(patterns.DEFINITIONS)
    mentioned = rows.select(F.inline(patterns.mentions(F.col("text"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in mentioned


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, 0, "As in [1-2], [ABC+98; X] and Qa (2001)."), (2, 0, "[7] and [abc]")], "doc_id long, page_no int, body string")
    refs = spark.createDataFrame([(1, 1, "1", "[1] Qa, B. T. 2001.", "2001"), (1, 2, "2", "[2] Qc, D. T. 2002.", "2002"), (1, 3, "ABC+98", "x", "1998")], "doc_id long, ref_ord int, ref_index string, text string, year string")
    found = C.inline_citations(pages, refs)
    assert sorted((r.type, r.begin, r.refs) for r in found.collect()) == [("author-year", 29, [1]), ("numeric", 6, [1, 2])]
    both = C.with_superscripts(found, spark.createDataFrame([(2, 0, 0.5)], "doc_id long, page_no int, confidence double"))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") + both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    assert sorted((r.doc_id, r.type) for r in both.collect()) == [(1, "author-year"), (1, "numeric"), (2, "superscript")]


def test_votes_are_shuffled_not_texts(spark):
    refs = spark.createDataFrame([(1, k, str(k % 2), f"[{k}] One, A. 200{k}.", "2001") for k in range(3)], "doc_id long, ref_ord int, ref_index string, text string, year string")
    plan = C.inline_format(refs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Window", 1)[0] and "[doc_id" in plan
    window = next(x for x in plan.splitlines() if "row_number" in x)
    assert "text#" not in window and plan.index("RLIKE") > plan.index("row_number")


def test_equal_indices_and_keys(spark):
    """Of equal indices the first entry counts, of equal keys the last; numbers without an entry lower the confidence."""
    refs = spark.createDataFrame([(1, k, i, "x", None) for k, i in ((1, "2"), (2, "2"), (3, "ABC99"), (4, "abc99"), (5, None))] + [(2, 1, "7", "x", None)], "doc_id long, ref_ord int, ref_index string, text string, year string")
    pages = spark.createDataFrame([(1, 1, "as in [2, 7] and [ABC99] but [7]")], "doc_id long, page_no int, body string")
    assert sorted((r.type, r.refs, r.confidence) for r in C.inline_citations(pages, refs).collect()) == [("abbreviated", [4], 0.6), ("numeric", [1], 0.5)]
