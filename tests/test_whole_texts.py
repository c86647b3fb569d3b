"""Registered queries that read whole texts."""

import duckdb
import pytest

from foliograph.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "\n".join(f"There is line {k}" for k in range(130)))], "doc_id long, text string").write.parquet(f"{to}/documents.parquet")
    return str(to)


def test_search_beyond_the_second_page(spark, tables):
    got = registry.QUERIES["search_hits"](spark, tables).collect()
    assert sorted((r.page_no, r.line_no, r.match_id) for r in got) == [(k // 40 + 1, k, k) for k in range(130)]


def test_titles_are_whole_first_lines(spark, tmp_path):
    line = "A title of many words, " * 9
    spark.createDataFrame([(1, line + "\nand a text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.title for r in registry.QUERIES["normalized_titles"](spark, str(tmp_path)).collect()}
    assert got == {1: ("a title of many words " * 9).strip(), 2: ""}


def test_titles_keep_what_ends_them(spark, tmp_path):
    body = "\n".join(" ".join(["word"] * 12) for _ in range(30))
    heads = ["Title: Nets and stars***", "Nets\u00a0", "Deep ab- c"]
    spark.createDataFrame([(k, f"{t}\n{body}") for k, t in enumerate(heads)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.title for r in registry.QUERIES["document_titles"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1] for r in duckdb.sql(registry.ORACLES["document_titles"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()}
    assert got[0] == heads[0]


def test_headings_cut_within_an_entity(spark, tmp_path):
    heads = ["the&amp;&amp", "a &lt;b&gt; &ltc &amp;lt;", "&quot;x&quot"]
    spark.createDataFrame([(k, f"<h1>{t}</h1>") for k, t in enumerate(heads)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.heading for r in registry.QUERIES["page_headings"](spark, str(tmp_path)).collect()}
    assert got == {0: "the&&amp", 1: "a <b> &ltc &lt;", 2: '"x&quot'}
