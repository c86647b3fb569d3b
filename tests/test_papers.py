"""Operators over papers on small cases that the queries' tables don't hold."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from foliograph.functions import patterns, scanner
from foliograph.functions import text as T
from foliograph.operators import annotations as A
from foliograph.operators import citations as C
from foliograph.operators import details, glyphs, layout, links, markup, outline, references, store, trails, trees
from foliograph.sources import http as web

LINE = "doc_id long, page_no int, line_no int, text string, x double, y double, w double, h double, style int"


def lines(spark, rows):
    return spark.createDataFrame([(1, p, k, t, x, y, w, h, s) for k, (p, t, x, y, w, h, s) in enumerate(rows)], LINE)


def body(page, n, start=0):
    """Plain lines of a page, from the top down."""
    return [(page, f"plain text of a line {k + start}", 72.0, 700.0 - 12 * (k + start), 300.0, 10.0, 0) for k in range(n)]


# ---- reading


def read(spark, text, rule):
    """What a rule of columns reads in one text."""
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[1,2;3]", [("numeric", 0, 7, "1,2;3")]),
        ("[ 1] [1 ] [1,] [a1] []", []),
        ("[1]—[4] [9]-[3]", [("between", 0, 7, "1-4"), ("numeric", 8, 3, "9"), ("numeric", 12, 3, "3")]),
        ("[1]-[99]", [("numeric", 0, 3, "1"), ("numeric", 4, 4, "99")]),
        ("[AB12] [ABc+99z; Xy00] [A12] [AB123] [ab12]", [("abbreviated", 0, 6, "AB12"), ("abbreviated", 7, 15, "ABc+99z; Xy00")]),
        ("[[7]]", [("numeric", 1, 3, "7")]),
        ("𝐀[5]", [("numeric", 1, 3, "5")]),
        ("[1\xa0–\xa03]", [("numeric", 0, 7, "1\xa0–\xa03")]),
    ],
)
def test_brackets(spark, text, want):
    assert [tuple(x) for x in read(spark, text, patterns.bracket_citations)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Figs. 1-3, 5 & 7a", [("figure", 0, 17, "1-3, 5 & 7a")]),
        ("fig1 config 2 Éfig. 3", [("figure", 0, 4, "1"), ("figure", 15, 6, "3")]),
        ("Table1 Tables 2 Table 2", [("table", 16, 7, "2")]),
        ("Eqs. (3.1) eqn 4 Equation (5", [("equation", 0, 10, "3.1"), ("equation", 11, 5, "4"), ("equation", 17, 11, "5")]),
        ("§2.1.3 and § D.1", [("sectionMark", 0, 6, "2.1.3"), ("sectionMark", 11, 5, "D.1")]),
        ("Sec. A.2, Sections 3", [("section", 0, 8, "A.2")]),
        ("Appendix B.1.2, App. C, Appendix 3", [("appendix", 0, 12, "B.1"), ("appendix", 16, 6, "C")]),
        ("Lemma 2.3.4 Alg. 7", [("theorem", 0, 9, "2.3"), ("algorithm", 12, 6, "7")]),
    ],
)
def test_mentions(spark, text, want):
    assert sorted((tuple(x) for x in read(spark, text, patterns.mentions)), key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])


@pytest.mark.parametrize(
    ("line", "want"),
    [("Figure 3: A", ("figure", "3")), ("Fig 4b. A", ("figure", "4b")), ("Figure 3 shows", None), ("TABLE 2 no sign", ("table", "2")), ("Tables 2", None), ("Theorem 1.2. Let", ("theorem", "1.2")), ("Theorem 1.2 Let", None), ("Algorithm 1: X", ("algorithm", "1")), ("§ 2.1 Title", ("sectionMark", "2.1")), ("§2.1", None), ("A Figure 3:", None)],
)
def test_definitions(spark, line, want):
    got = read(spark, line, patterns.definition)
    assert (tuple(got) if got else None) == want


def test_years():
    assert scanner.each_year("2009a,b, 2011 , 2012c") == ["2009a", "2009b", "2011", "2012c"]


def test_confidence_goes_with_the_format(spark):
    refs = spark.createDataFrame([(1, k, str(k), f"Smith, A. Title {k}. 200{k}.", f"200{k}") for k in range(1, 7)], "doc_id long, ref_ord int, ref_index string, text string, year string")
    pages = spark.createDataFrame([(1, 1, "By [1, 9] and Smith (2002); (Smith, 2003, 2004) and [7].")], "doc_id long, page_no int, body string")
    got = {(r.type, r.begin): (r.refs, r.confidence, r.flags) for r in C.inline_citations(pages, refs).collect()}
    assert got == {("numeric", 3): ([1], 0.3, 0), ("author-year", 14): ([2], 1.0, 0), ("author-year", 29): ([3, 4], 1.0, 24)}
    skip = spark.createDataFrame([(1, 0, 2)], "doc_id long, start_page int, end_page int")
    assert C.inline_citations(pages, refs, skip).collect() == []


def test_format_after_short_lines(spark):
    rows = [(1, k, "short") for k in range(50)] + [(1, 50 + k, f"[{k}] Some author and a title") for k in range(50)] + [(2, 1, "x")]
    got = {r.doc_id: (r.format, r.sampled) for r in C.entry_format(spark.createDataFrame(rows, "doc_id long, ref_ord int, text string")).collect()}
    assert got == {1: ("numbered-bracket", 50), 2: ("unknown", 0)}
    hanging = [(1, k, "words without any mark", 72.0 + 10 * (k % 2), 10.0) for k in range(8)]
    assert C.entry_format(spark.createDataFrame(hanging, "doc_id long, ref_ord int, text string, x double, font_size double")).first().format == "hanging-indent"


# ---- references


def test_section_by_probe_and_by_outline(spark):
    rows = body(1, 20) + body(2, 20) + [(3, f"[{k}] entry number {k}", 72.0, 700.0 - 24 * k, 300.0, 10.0, 0) for k in range(1, 9)]
    rows += [(3, "Appendix", 72.0, 400.0, 60.0, 16.0, 1), (3, "what follows it", 72.0, 380.0, 60.0, 10.0, 0)]
    found = references.sections(lines(spark, rows)).collect()
    assert [(r.start_line, r.end_line, r.tier) for r in found] == [(39, 47, 3)]
    named = spark.createDataFrame([(1, 1, 0, 5, "7 References", 1, 72.0, 580.0)], "doc_id long, node_id long, parent_id long, ord int, title string, page_index int, left double, top double")
    assert [(r.start_line, r.tier) for r in references.sections(lines(spark, rows), named).collect()] == [(30, 1)]
    kept = references.section_lines(lines(spark, rows), references.sections(lines(spark, rows))).collect()
    assert sorted(r.line_no for r in kept) == [*range(40, 48)]


def test_descending_numbers():
    assert references.descending([0, 3, 6], [9, 8, 7]) == (2, 3.0)
    assert references.descending([0, 3, 30], [9, 8, 7]) is None
    assert references.descending([0, 1, 2, 3, 4], [4, 9, None, 8, 7]) is None
    assert references.descending([0, 1, 2, 3], [5, 9, 8, 7]) == (3, 1.0)
    assert references.descending([], []) is None


def test_text_of_a_reference(spark):
    rows = [(1, "[1] Smith, A. A title that fills the line,", 72.0, 700.0, 300.0, 10.0, 0), (1, " goes on to here 2001.", 84.0, 688.0, 300.0, 10.0, 0), (1, "[2] Lee, B. Another", 72.0, 676.0, 300.0, 10.0, 0), (2, "no number here", 72.0, 700.0, 300.0, 10.0, 0), (2, "and its second line", 72.0, 688.0, 100.0, 10.0, 0), (2, "belongs to others", 72.0, 676.0, 300.0, 10.0, 0)]
    rows = lines(spark, rows)
    metrics = rows.select("doc_id").distinct().withColumn("line_width", F.lit(300.0))
    refs = spark.createDataFrame([(1, 1, "5", "Brown, C. By index. 1999.", "1999"), (1, 2, "6", "Green, D. By name. 2003.", "2003")], "doc_id long, ref_ord int, ref_index string, text string, year string")
    cited = spark.createDataFrame([(1, 1, "5", None, None, None, None, None), (1, 2, "77", "green", "2003", None, None, None), (1, 3, None, None, None, 1, 70.0, 702.0), (1, 4, None, None, None, 2, 72.0, 699.0), (1, 5, None, None, None, 2, 72.0, 0.0)], "doc_id long, cit_no long, ref_index string, author string, year string, page_no int, x double, y double")
    columns = spark.createDataFrame([(1, 1, False)], "doc_id long, page_no int, multi_column boolean")
    got = {r.cit_no: r.text for r in details.citation_texts(cited, refs, rows, metrics, columns).collect()}
    assert got == {1: "Brown, C. By index. 1999.", 2: "Green, D. By name. 2003.", 3: "[1] Smith, A. A title that fills the line, goes on to here 2001.", 4: "no number hereand its second line", 5: "invalid location"}


# ---- links


def test_links_confirm_and_fill(spark):
    rect = lambda x, y: {"x": x, "y": y, "w": 30.0, "h": 20.0}
    found = spark.createDataFrame([(1, 1, 1, "numeric", [rect(0.0, 0.0)], ["1"], 0.5, 0), (1, 1, 2, "author-year", [rect(100.0, 0.0)], ["2"], 0.7, 0), (1, 1, 3, "numeric", [rect(200.0, 0.0)], ["3"], 0.2, 0), (1, 1, 4, "numeric", [rect(200.4, 0.2)], ["4"], 0.25, 0)], "doc_id long, page_no int, cit_no long, type string, rects array<struct<x:double,y:double,w:double,h:double>>, refs array<string>, confidence double, flags int")
    to = spark.createDataFrame([(1, 1, 1, rect(2.0, 2.0), True, "1", 9, 5.0, 6.0), (1, 1, 2, rect(102.0, 2.0), True, "7", 9, 7.0, 8.0), (1, 1, 3, rect(300.0, 0.0), False, None, 9, 0.0, 0.0), (1, 1, 4, rect(305.0, 1.0), True, None, 9, 0.0, 1.0)], "doc_id long, page_no int, link_no long, rect struct<x:double,y:double,w:double,h:double>, valid boolean, ref_index string, dest_page int, dest_x double, dest_y double")
    got = [(r.place, r.type, r.refs, round(r.confidence, 6), r.flags, r.dest_x) for r in links.merged_citations(found, to).orderBy("place").collect()]
    assert got == [(0, "numeric", ["1"], 0.7, 3, 5.0), (1, "author-year", ["7"], 0.7, 1, 7.0), (2, "imported", [None], 0.85, 3, 0.0)]


def test_bookmarks_are_found_in_order(spark):
    rows = lines(spark, [(1, "Introduction", 72.0, 700.0, 60.0, 14.0, 1), (1, "Methods", 72.0, 680.0, 60.0, 14.0, 1), (1, "B. Proofs of it", 72.0, 660.0, 60.0, 14.0, 1), (2, "Methods", 72.0, 700.0, 60.0, 14.0, 1), (2, "A very long heading about deep networks learning", 72.0, 690.0, 60.0, 14.0, 1)])
    marks = spark.createDataFrame([(1, 1, 0, "2 Methods", 0.0), (1, 2, 1, "Introduction", 0.0), (1, 3, 2, "Appendix B", 0.0), (1, 4, 3, "Methods", 0.0), (1, 5, 4, "Long heading about deep networks that learn", 0.0), (1, 6, 5, "Methods", 9.0)], "doc_id long, node_id long, ord int, title string, left double").withColumn("top", F.col("left"))
    metrics = rows.select("doc_id").distinct().withColumn("line_height", F.lit(10.0))
    assert {(r.node_id, r.line_no) for r in outline.located(marks, rows, metrics).collect()} == {(1, 1), (3, 2), (4, 3), (5, 4)}


# ---- trees, trails, state


def test_deep_and_circular_trees(spark):
    deep = spark.createDataFrame([(k, k - 1 if k else None, "n") for k in range(12)] + [(50, 49, "lost")], "node_id long, parent_id long, title string")
    assert sorted(r.depth for r in trees.flattened(deep).collect()) == [*range(12)]
    circle = spark.createDataFrame([(0, None, "r"), (1, 2, "a"), (2, 1, "b")], "node_id long, parent_id long, title string")
    with pytest.raises(ValueError, match="ancestor"):
        trees.flattened(circle)


def test_outline_keeps_large_sub_numbers(spark):
    rows = spark.createDataFrame([(1, 1, "2", 1), (1, 2, "2.500", 2), (1, 3, "500", 1), (1, 4, "9", 1), (1, 5, "3", 1), (1, 6, "3.1", 2), (1, 7, "4.1", 2), (1, 8, "", 2)], "doc_id long, ord long, prefix string, level int")
    assert {(r.ord, r.parent) for r in trees.outline(rows).collect()} == {(1, None), (2, 1), (5, None), (6, 5), (8, None)}


def test_two_clicks_two_papers(spark):
    kind = "user_id long, event_id long, ts timestamp_ntz, title string, url string"
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    clicks = spark.createDataFrame([(1, 1, at(0), "A paper", None), (1, 2, at(1), "A paper", None), (2, 3, at(0), None, "https://x.org/abs/1"), (3, 4, at(0), "One title", None), (4, 5, at(0), "Same", None), (4, 6, at(0), "Same", None)], kind)
    opened = spark.createDataFrame([(1, 11, at(2), "A Paper!", None), (1, 12, at(3), "a  paper", None), (1, 13, at(4), "A paper", None), (2, 14, at(10), "Whatever", "https://X.org/abs/1?q=2"), (3, 15, at(11), "One title", None), (3, 16, at(9), "Another", None), (4, 17, at(1), "Same", None), (4, 18, at(2), "Same", None)], kind)
    assert {(r.open_id, r.click_id) for r in trails.matched(clicks, opened).collect()} == {(11, 1), (12, 2), (14, 3), (17, 5)}


def test_settings_and_updates(spark):
    rows = spark.createDataFrame([('"a"',), ("plain text",), ("12",), (None,), ("{bad",)], "v string")
    assert [r[0] for r in rows.select(store.setting(F.col("v"), "string")).collect()] == ["a", "plain text", "12", None, "{bad"]
    changes = spark.createDataFrame([("k", 1, "put", 5), ("k", 2, "put", 6), ("d", 1, "put", 1), ("d", 1, "delete", None)], "id string, at long, op string, v int")
    assert [(r.id, r.v) for r in store.current(changes, ["id"]).collect()] == [("k", 6)]


# ---- markup, colours, strokes

PAGE = """<div class="gs_r" data-cid="c1"><div class="gs_ri"><h3 class="gs_rt"><span>[PDF]</span><a href="https://h.org/a?b=1&amp;c=2">A <b>title</b> &amp; more</a></h3>
<div class="gs_fmaa"><a>A One</a>, <a> B Two </a><a></a></div><div class="gsh_csp">short</div><div class="gs_fma_snp">a longer <br>one</div></div></div><div class="gs_ri"><h3 class="gs_rt"><a>Other</a></h3></div>"""
CITES = '<th class="gs_cith">MLA</th><td><div class="gs_citr">One, A. <i>Title</i>.</div></td><th class="gs_cith">APA</th><td><div class="gs_citr"></div></td><div id="gs_citi"><a href="/end">E</a><a href="/x.bib?a=1&amp;b=2">B</a></div>'


def test_search_results(spark):
    rows = spark.createDataFrame([(PAGE,), ("<p>nothing</p>",), (None,)], "html string").select("html", markup.search_result("html").alias("r"), markup.paper_id(F.col("html")).alias("id")).collect()
    assert tuple(rows[0].r) == ("A title & more", "https://h.org/a?b=1&c=2", ["A One", "B Two"], "a longer one") and rows[0].id == "c1"
    assert tuple(rows[1].r) == tuple(rows[2].r) == (None, None, None, None)
    got = spark.createDataFrame([(CITES,)], "h string").select(markup.bibliography_link(F.col("h"), "https://s.org").alias("l"), markup.citation_formats(F.col("h")).alias("f")).first()
    assert got.l == "https://s.org/x.bib?a=1&b=2" and got.f[0].citation == "One, A. Title."


def test_colors(spark):
    rows = spark.createDataFrame([("E53935",), ("#1e88e6",), ("nothing",), ("#12345",), (None,)], "c string")
    assert [r.color_name for r in markup.nearest_color(rows, "c").collect()] == ["red", "blue", "yellow", "yellow", "yellow"]


def test_brush_with_friction(spark):
    rows = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}],), (None,)], "p array<struct<x:double,y:double>>")
    got = rows.select(A.lazy_brush(F.col("p"), 2.0, 0.4).alias("b")).collect()
    assert got[0].b[1].x == pytest.approx(8 * (1 - (1 - 0.36) ** 0.5)) and got[1].b is None


def test_ratio_rects(spark):
    rows = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.2, 0.02), (1, 2, 0.305, 0.101, 0.1, 0.02), (1, 3, 0.6, 0.1, 0.1, 0.02), (1, 4, 0.1, 0.2, 0.1, 0.02)], "mark_id long, rect_no int, x double, y double, w double, h double")
    assert sorted((round(r.left, 3), round(r.right, 3), r.n) for r in A.merged_ratio_rects(rows).collect()) == [(0.1, 0.2, 1), (0.1, 0.405, 2), (0.6, 0.7, 1)]


# ---- layout


def test_body_without_bands(spark):
    rows = lines(spark, [(1, f"line {k}", 72.0, 780.0 - 12 * k, 300.0, 20.0 if k < 8 else 10.0, 0) for k in range(20)])
    banded = glyphs.banded(rows).withColumn("font_size", F.lit(9.96))
    m = layout.body_metrics(banded).first()
    assert (m.font_size, m.line_height, m.line_width, m.margin_bottom) == (10.0, 10.0, 300.0, 552.0)


def test_title_match_in_python(spark):
    pairs = [("a b c", "c x a"), ("abcdefghijklmno", "abcdefghijklmnop q"), ("two words", "two words"), ("", ""), ("one two", "one two three"), ("x y z w", "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.titles_match(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(T.similar_titles(r.a, r.b) == (r.m or (r.a == r.b and r.a != "")) for r in rows)


def test_http_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/a.pdf" else 404)
            self.send_header("Content-Type", "application/pdf")
            self.end_headers()
            self.wfile.write(b"%PDF-1.7")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        web.register(spark)
        base = f"http://127.0.0.1:{server.server_port}"
        rows = {r.url: r for r in spark.read.format("foliograph_http").option("urls", f"{base}/a.pdf {base}/b.pdf nothing").load().collect()}
    finally:
        server.shutdown()
    assert (rows[f"{base}/a.pdf"].status, bytes(rows[f"{base}/a.pdf"].content)) == (200, b"%PDF-1.7")
    assert rows[f"{base}/b.pdf"].status == 404 and rows["nothing"].error
