"""Scalar functions on cases worked out by hand."""

from pyspark.sql import functions as F

from foliograph.functions import stats
from foliograph.functions import text as T
from foliograph.operators import citations, layout, markup, trees


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_number_lists(spark):
    expand = lambda s: value(spark, T.expand_numbers(F.lit(s)))
    assert expand("1-3, 5, 7-9") == [1, 2, 3, 5, 7, 8, 9]
    assert expand("10-60") == [*range(10, 41)]
    assert expand("0") == expand("1000") == expand("5-3") == []


def test_years(spark):
    years = lambda s: value(spark, T.years(F.lit(s)))
    assert years("2009a,b") == ["2009a", "2009b"]
    assert years("1996-2004") == []
    assert years("2008, 2013") == ["2008", "2013"]


def test_section_numbers(spark):
    parts = lambda s: value(spark, T.prefix_parts(F.lit(s)))
    assert parts("2.1") == [2, 1]
    assert parts("IV") == [4]
    assert parts("A.1") == [1, 1]
    assert parts("C") == [3]
    assert value(spark, T.strip_section_number(F.lit("2.1. Methods"))) == "Methods"
    assert value(spark, T.appendix_letter(F.lit("appendix b Data"))) == "B"


def test_titles(spark):
    match = lambda a, b: value(spark, T.titles_match(F.lit(a), F.lit(b)))
    assert match("a study of things", "a study of things in general")
    assert not match("two words", "two words more")
    assert match("deep nets learn", "nets learn much more slowly")
    assert not match("nets learn much more slowly now", "deep nets learn")
    assert value(spark, T.normalize_title(F.lit("  A  Study: of é X "))) == "a study of x"
    assert value(spark, T.normalize_title(F.lit(None).cast("string"))) == ""


def test_addresses(spark):
    fragment = lambda u: value(spark, T.url_fragment(F.lit(u)))
    assert fragment("https://arxiv.org/abs/2404.19178v2") == "2404.19178"
    assert fragment("https://doi.org/10.1234/abcde") == "10.1234/abcde"
    assert fragment("https://Example.org/a/b?x=1#y") == "example.org/a/b"
    assert fragment("nothing") == "nothing"
    assert value(spark, T.file_name(F.lit("https://x.org/a/paper?v=1"))) == "paper.pdf"


def test_small_functions(spark):
    assert value(spark, T.pdf_date(F.lit("D:20240131235900Z"))) == "2024-01-31 23:59"
    assert value(spark, T.pdf_date(F.lit(""))) == "Unknown"
    assert value(spark, T.escape_html(F.lit('<a href="x">&'))) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert value(spark, T.clean_copy(F.lit("exam- ple\ntext"))) == "example text"
    assert value(spark, T.page_range(F.lit("+ 3"), F.lit(2), F.lit(4))) == 4
    assert value(spark, T.page_range(F.lit("2"), F.lit(2), F.lit(4))) is None


def test_mode_and_medians(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 3, 1, 2])], "k int, i int, v int")
    assert stats.mode_first_seen(rows, ["k"], "v", ["i"]).first().mode == 3
    four = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    got = four.agg(stats.upper_median("v").alias("u"), stats.middle_median(F.col("v")).alias("m"), stats.nearest_rank("v", 90).alias("p")).first()
    assert (got.u, got.m, got.p) == (3.0, 2.5, 4.0)
    assert four.where("v > 9").agg(stats.middle_median(F.col("v")).alias("m")).first().m == 0.0


def test_citations(spark):
    body = spark.createDataFrame([(1, "As [1-3], [5]–[7] and [9]–[2]; [ABC+23] too.")], "doc_id long, body string")
    found = {(r.kind, r.content) for r in citations.citations(body).collect()}
    assert found == {("numeric", "1-3"), ("between", "5-7"), ("numeric", "9"), ("numeric", "2"), ("abbreviated", "ABC+23")}


def test_author_match(spark):
    refs = spark.createDataFrame([(1, 1, "[1] Smith, J. Title. 2001.", "2001"), (1, 2, "[2] Jones and Smith. 2001.", "2001"), (1, 3, "[3] Brown. 1999.", "1999")], "doc_id long, ref_ord int, text string, year string")
    cited = spark.createDataFrame([(1, 0, "Smith", "2001"), (1, 9, "Jones", "2001"), (1, 20, "Other", "1999"), (1, 30, "Other", "2001")], "doc_id long, begin int, author string, year string")
    got = {(r.begin, r.ref_ord, r.confidence) for r in citations.matched_authors(cited, refs).collect()}
    assert got == {(0, 1, 1.0), (9, 2, 1.0), (20, 3, 0.5)}


def test_line_groups_and_tiers(spark):
    items = spark.createDataFrame([(1, 1, i, y, 8.0) for i, y in enumerate([100.0, 95.0, 91.0, 80.0])], "doc_id long, page_no int, ord int, y double, h double")
    assert [r.line for r in layout.group_lines(items).orderBy("ord").collect()] == [0, 0, 1, 2]
    tiers = value(spark, layout.size_tiers(F.array(*(F.lit(float(x)) for x in (10, 12, 11.5, 20)))))
    assert [(t.size, t.tier) for t in tiers] == [(20.0, 0), (12.0, 1), (11.5, 1), (10.0, 2)]


def test_outline(spark):
    rows = [(1, k, p, lv) for k, (p, lv) in enumerate([("1", 1), ("1.1", 2), ("2", 1), ("3.2", 2), ("8", 1), ("2.1", 2), ("500", 1)])]
    got = {r.ord: r.parent for r in trees.outline(spark.createDataFrame(rows, "doc_id long, ord long, prefix string, level int")).collect()}
    assert got == {0: None, 1: 0, 2: None}


def test_colors(spark):
    rows = spark.createDataFrame([("#FFB200",), ("#000001",), ("none",), (None,)], "c string")
    assert [r.color_name for r in markup.nearest_color(rows, "c").collect()] == ["yellow", "black", "yellow", "yellow"]
