"""Queries over papers made from orders and line items, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.text import abbreviated_keys
from foliograph.operators import citations as C
from foliograph.sources.adapters import PAPERS_SQL, REFERENCES_SQL, bodies, marked_sql, references, table


def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir)


def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.citations(bodies(spark, sf_dir))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cited_numbers(C.citations(bodies(spark, sf_dir)))


def citation_ref_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.linked(C.citations(bodies(spark, sf_dir)), references(spark, sf_dir))


def abbreviated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.citations(bodies(spark, sf_dir)).where("kind = 'abbreviated'")
    return found.select("doc_id", "begin", F.explode(abbreviated_keys(F.col("content"))).alias("key"))


def author_year_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claimed(C.matched_authors(C.author_years(bodies(spark, sf_dir)), references(spark, sf_dir))).drop("second")


def crossref_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions(bodies(spark, sf_dir))


def _caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("Figure "), F.lit("Table "), F.lit("Lemma "), F.lit("§"))
    return references(spark, sf_dir).select("doc_id", F.col("ref_ord").alias("line_no"), F.concat(F.get(kinds, F.col("ref_ord") % 4), F.col("ref_index").cast("string"), F.when(F.col("ref_ord") % 4 == 3, " ").otherwise(": "), F.col("author")).alias("text"))


def crossref_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.captions(_caption_lines(spark, sf_dir))


def defined_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin as captions do, of which those that look like definitions count: by a sign, a style, a size or capitals."""
    n = F.col("ref_ord")
    kinds = F.array(F.lit("Figure "), F.lit("Table "), F.lit("Lemma "), F.lit("Algorithm "))
    of = F.get(kinds, n % 4)
    rows = references(spark, sf_dir).select("doc_id", n.alias("line_no"), F.concat(of, F.col("ref_index").cast("string"), F.when(n % 5 == 0, ": ").otherwise(" "), F.col("author")).alias("text"), F.when(n % 7 == 0, F.upper(of)).when(n % 3 == 0, F.concat(of, F.lit("and much more"))).otherwise(of).alias("first_item"), (F.col("doc_id") % 3 % 2).cast("int").alias("style"), F.when(n % 11 < 4, 11.0).otherwise(10.0).alias("h"))
    return C.captions(rows, rows.select("doc_id").distinct().withColumn("font_size", F.lit(10.0)))


def crossref_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolved(C.mentions(bodies(spark, sf_dir)), C.captions(_caption_lines(spark, sf_dir)))


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries in six styles by their paper's key, each after three short lines: brackets, parentheses, full stops, plain
    numbers, keys, and names."""
    refs = references(spark, sf_dir)
    i, rest = F.col("ref_index").cast("string"), F.regexp_replace("text", r"^\[[0-9]+\] ", "")
    styles = (F.concat(F.lit("["), i, F.lit("] "), rest), F.concat(F.lit(" ("), i, F.lit(")"), rest), F.concat(i, F.lit(". "), rest), F.concat(i, F.lit(" "), rest), F.concat(F.lit("[Key0"), i, F.lit("] "), rest), F.concat(F.col("author"), F.lit(", A. "), F.col("year")))
    text = F.coalesce(*(F.when(F.col("doc_id") % 6 == k, x) for k, x in enumerate(styles)))
    few = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("   [9] x     ").alias("t")), F.struct(F.lit(2).alias("k"), text.alias("t"))))
    return refs.select("doc_id", "ref_ord", few.alias("p")).select("doc_id", (F.col("ref_ord") * 2 + F.col("p.k")).alias("ref_ord"), F.col("p.t").alias("text"))


def ref_format_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.entry_format(_styled(spark, sf_dir))


def inline_format_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inline_format(_styled(spark, sf_dir).where("text NOT LIKE '%[9] x%'")).select("doc_id", "format", F.round("confidence", 6).alias("confidence"))


def abbreviated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).withColumn("ref_index", F.concat(F.lit("abc+9"), F.col("ref_index").cast("string")))
    return C.abbreviated_linked(C.citations(bodies(spark, sf_dir)), refs)


def loose_author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("q"), F.translate(F.max("l_suppkey").cast("string"), "0123456789", "abcdefghij")).alias("author"), F.max(F.year("l_shipdate")).cast("string").alias("year"))
    return C.loosely_matched(cited, references(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir).withColumn("page_no", (F.col("doc_id") % 3).cast("int"))


def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of all pages but those within reference sections, which every other paper has on pages 0 to 2."""
    pages = _pages(spark, sf_dir)
    sections = pages.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("start_page"), F.lit(2).alias("end_page"))
    found = C.inline_citations(pages, references(spark, sf_dir), sections)
    return found.select("doc_id", "page_no", "type", "begin", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), "confidence", "flags")


def reference_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.anchors(references(spark, sf_dir).select("doc_id", "ref_ord", "text")).drop("text")


def page_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations of a page, superscripts on pages with few others: each order's sentence is a page of one of three documents in turn."""
    found = C.inline_citations(_pages(spark, sf_dir), references(spark, sf_dir))
    raised = superscript_citations(spark, sf_dir).withColumn("page_no", (F.col("doc_id") % 3).cast("int"))
    return C.with_superscripts(found, raised).groupBy("doc_id", "page_no", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


def superscript_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    text = F.when(F.col("ref_ord") % 3 == 0, F.concat(F.lit("a"), F.col("ref_index").cast("string"), F.lit(","))).when(F.col("ref_ord") % 3 == 1, F.col("ref_index").cast("string")).otherwise("word")
    items = refs.select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("line_no"), F.col("ref_ord").alias("item_no"), text.alias("text"), (F.col("ref_ord") * 6.0).alias("x"), F.lit(5.0).alias("width"), F.when(F.col("ref_ord") % 3 == 2, 10.0).otherwise(5.0).alias("height"))
    return C.superscripts(items, refs)


def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    two = F.array(F.struct((F.col("ref_ord") * 2).alias("line_no"), F.regexp_extract("text", r"^(.*?) Part", 1).alias("text")), F.struct((F.col("ref_ord") * 2 + 1).alias("line_no"), F.regexp_extract("text", r"(Part.*)$", 1).alias("text")))
    return C.numbered_entries(refs.select("doc_id", F.explode(two).alias("l")).select("doc_id", "l.*"))


QUERIES = {f.__name__: f for f in (reference_entries, citation_spans, citation_numbers, citation_ref_join, abbreviated_citations, abbreviated_links, author_year_match, loose_author_match, inline_citations, page_citations, reference_anchors, superscript_citations, crossref_mentions, crossref_targets, defined_captions, crossref_resolution, ref_format_vote, inline_format_vote, numbered_entries)}

# the oracles know how the sentences are made, not how they are read
_PARTS = f"""WITH {PAPERS_SQL}, {REFERENCES_SQL},
spans AS MATERIALIZED ({marked_sql("bracket")}),
listed AS MATERIALIZED (SELECT doc_id, kind, "begin", length, unnest(range(len(ns)))::INT AS place, unnest(ns)::INT AS number FROM spans WHERE kind <> 'abbreviated'),
cited AS MATERIALIZED ({marked_sql("author")}),
mentions AS ({marked_sql("mention")}),
entries AS MATERIALIZED (SELECT doc_id, ref_index AS number, min(ref_ord) AS ref_ord FROM refs GROUP BY ALL),
judged AS MATERIALIZED (SELECT doc_id, "begin", any_value(length) AS length, count(*) AS total, count(ref_ord) AS valid, min(ref_ord) AS first_ref, string_agg(ref_ord, ',' ORDER BY place) AS refs FROM listed LEFT JOIN entries USING (doc_id, number) GROUP BY 1, 2),
tried AS MATERIALIZED (SELECT c.doc_id, c."begin", c.author, c.y::VARCHAR AS year, r.ref_ord, CASE WHEN r.author = c.author THEN 1.0 WHEN count(*) OVER (PARTITION BY c.doc_id) = 1 THEN 0.5 END AS confidence FROM cited c JOIN refs r ON r.doc_id = c.doc_id AND r.year = c.y::VARCHAR),
authors AS MATERIALIZED (SELECT doc_id, "begin", author, year, arg_min(ref_ord, (-confidence, ref_ord)) AS ref_ord, max(confidence)::DOUBLE AS confidence FROM tried WHERE confidence IS NOT NULL GROUP BY 1, 2, 3, 4),
captions AS (SELECT doc_id, ['figure', 'table', 'theorem', 'sectionMark'][ref_ord % 4 + 1] AS kind, ref_index::VARCHAR AS target, min(ref_ord) AS line_no FROM refs GROUP BY ALL)"""
_KEYS = """keys AS (SELECT doc_id, "begin", unnest(string_split(content, ', ')) AS key FROM spans WHERE kind = 'abbreviated')"""
_STYLES = "['numbered-bracket', 'numbered-paren', 'numbered-dot', 'numbered-plain', 'numbered-abbr', 'author-year'][doc_id % 6 + 1]"
ORACLES = {
    "reference_entries": f"WITH {REFERENCES_SQL} SELECT * FROM refs",
    "citation_spans": f'{_PARTS} SELECT doc_id, kind, "begin", length, content FROM spans',
    "citation_numbers": f'{_PARTS} SELECT doc_id, "begin", place, number FROM listed',
    "citation_ref_join": f'{_PARTS} SELECT doc_id, "begin", total, valid, first_ref, round(valid / total, 6) AS confidence FROM judged WHERE valid > 0 AND valid / total >= 0.3',
    "abbreviated_citations": f'{_PARTS}, {_KEYS} SELECT doc_id, "begin", key FROM keys',
    "abbreviated_links": f"""{_PARTS}, {_KEYS}, e AS (SELECT doc_id, 'abc+9' || ref_index AS ref_index, max(ref_ord) AS ref_ord FROM refs GROUP BY 1, 2)
      SELECT doc_id, "begin", key, ref_index, ref_ord FROM keys JOIN e USING (doc_id) WHERE lower(key) = ref_index""",
    "author_year_match": f'{_PARTS} SELECT doc_id, "begin", author, year, ref_ord, confidence FROM authors',
    "loose_author_match": f"""WITH {REFERENCES_SQL}, c AS (SELECT l_orderkey AS doc_id, 'q' || translate(max(l_suppkey)::VARCHAR, '0123456789', 'abcdefghij') AS author, max(year(l_shipdate))::VARCHAR AS year FROM lineitem GROUP BY 1)
      SELECT c.doc_id, c.author, c.year, coalesce(min(ref_ord) FILTER (strpos(lower(r.author), c.author) > 0), min(ref_ord)) AS ref_ord FROM c LEFT JOIN refs r ON r.doc_id = c.doc_id AND r.year = c.year GROUP BY 1, 2, 3""",
    "inline_citations": f"""{_PARTS}, every AS (SELECT doc_id, 'numeric' AS type, "begin", refs, valid / total AS confidence, CASE WHEN content LIKE '%-%' OR content LIKE '%—%' THEN 4 ELSE 0 END + CASE WHEN valid > 1 THEN 8 ELSE 0 END AS flags FROM judged JOIN (SELECT doc_id, "begin", content FROM spans) USING (doc_id, "begin") WHERE valid > 0
        UNION ALL SELECT doc_id, 'author-year', "begin", ref_ord::VARCHAR, confidence * 0.6, 0 FROM authors)
      SELECT doc_id, (doc_id % 3)::INT AS page_no, type, "begin", refs, round(confidence, 6) AS confidence, flags FROM every WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 = 1)""",
    "reference_anchors": f"""WITH {REFERENCES_SQL} SELECT doc_id, ref_ord, regexp_extract(text, '(?:^|[^A-Za-z0-9_])((?:19|20)[0-9]{{2}})(?:[^A-Za-z0-9_]|$)', 1) AS year, lower(regexp_replace(text, '^[^ ]* ', '')[1:40]) AS author_search_text, false AS has_multiple_authors FROM refs""",
    "superscript_citations": f"""WITH {REFERENCES_SQL}, pairs AS (SELECT a.doc_id, a.ref_ord * 6.0 AS x, a.ref_index AS i, b.ref_index AS j FROM refs a LEFT JOIN refs b ON a.doc_id = b.doc_id AND b.ref_ord = a.ref_ord + 1 WHERE a.ref_ord % 3 = 0
        UNION ALL SELECT doc_id, ref_ord * 6.0, NULL, ref_index FROM refs WHERE ref_ord = 1)
      SELECT doc_id, 1 AS page_no, 1 AS line_no, x::DOUBLE AS x, concat_ws(',', i, j) AS content, (i IS NOT NULL)::BIGINT + (j IS NOT NULL)::BIGINT AS total, (i IS NOT NULL)::BIGINT + (j IS NOT NULL)::BIGINT AS valid, 1.0::DOUBLE AS confidence FROM pairs""",
    "page_citations": None,
    "crossref_mentions": f'{_PARTS} SELECT doc_id, kind, "begin", length, content AS target FROM mentions',
    "crossref_targets": f"{_PARTS} SELECT * FROM captions",
    "defined_captions": f"""WITH {REFERENCES_SQL}, n AS (SELECT doc_id, ref_ord, ref_index, ['figure', 'table', 'theorem', 'algorithm'][ref_ord % 4 + 1] AS kind, ['Figure ', 'Table ', 'Lemma ', 'Algorithm '][ref_ord % 4 + 1] AS word, doc_id % 3 = 1 AS styled, ref_ord % 7 = 0 AS capitals FROM refs)
      SELECT doc_id, kind, ref_index::VARCHAR AS target, min(ref_ord) AS line_no FROM n WHERE ref_ord % 5 = 0 OR (kind = 'table' AND (styled OR capitals) AND (capitals OR ref_ord % 3 > 0)) GROUP BY 1, 2, 3""",
    "crossref_resolution": f'{_PARTS} SELECT doc_id, kind, content AS target, "begin", length, line_no FROM mentions LEFT JOIN (SELECT doc_id, kind, target AS content, line_no FROM captions) USING (doc_id, kind, content)',
    "ref_format_vote": f"WITH {REFERENCES_SQL} SELECT doc_id, {_STYLES} AS format, least(count(*), 50) AS sampled FROM refs GROUP BY 1",
    "inline_format_vote": f"WITH {REFERENCES_SQL} SELECT doc_id, {_STYLES} AS format, 1.0::DOUBLE AS confidence FROM refs GROUP BY 1",
    "numbered_entries": f"WITH {REFERENCES_SQL} SELECT doc_id, ref_ord AS entry, ref_index::VARCHAR AS ref_index, text FROM refs",
}
_FOUND = ORACLES["inline_citations"].split("SELECT doc_id, (doc_id % 3)::INT AS page_no")[0]
_RAISED = ORACLES["superscript_citations"].split("pairs AS (")[1].split("SELECT doc_id, 1 AS page_no")[0].strip().removesuffix(")")
ORACLES["page_citations"] = f"""{_FOUND.rstrip()}, pairs AS ({_RAISED}), full_pages AS (SELECT doc_id FROM every GROUP BY 1 HAVING count(*) >= 5),
  both_kinds AS (SELECT doc_id, type, confidence FROM every UNION ALL SELECT doc_id, 'superscript', 1.0 FROM pairs WHERE doc_id NOT IN (SELECT doc_id FROM full_pages))
  SELECT doc_id, (doc_id % 3)::INT AS page_no, type, count(*) AS n, round(sum(round(confidence, 6)), 6)::DOUBLE AS confidence FROM both_kinds GROUP BY 1, 2, 3"""
