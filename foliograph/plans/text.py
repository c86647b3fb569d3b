"""Queries over titles, addresses, markup, number lists and colours, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions.folds import cut
from foliograph.operators import glyphs, layout, markup, titles
from foliograph.plans.layout import TITLES_SQL
from foliograph.sources import files
from foliograph.sources.adapters import lines, table


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole first line of each document as its title."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


def normalized_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_title(F.col("p_name")).alias("title"))


def url_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_fragment(F.col("url")).alias("fragment"))


def url_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"))


def number_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    content = F.concat_ws(", ", n.cast("string"), F.concat(n.cast("string"), F.lit("-"), (n + (F.col("l_quantity") % 7).cast("int")).cast("string")), (n * 400).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(T.expand_numbers(content)).alias("place", "number"))
    return rows


def year_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate").cast("string")
    text = F.concat(y, F.lit("a,b, "), y, F.lit(", 1996-2004, "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(T.years(text)).alias("place", "year"))


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 5).cast("string"), F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.number_prefix(heading).alias("prefix"), T.number_depth(T.number_prefix(heading)).alias("depth"), T.strip_section_number(heading).alias("plain"), F.element_at(T.prefix_parts(T.number_prefix(heading)), 1).alias("first_part"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' titles, normalised. Titles and body metrics are of the first six pages' lines, which are typeset once, and a title's words of page 1."""
    made = lines(spark, sf_dir, pages=layout.BODY_PAGES)
    rows = cut(made.withColumn("text", F.when(F.col("page_no") == 1, F.col("text"))).drop("x"))
    return layout.titles(rows, layout.body_metrics(rows), whole=True).select("doc_id", T.normalize_title(F.col("title")).alias("title"))


def fuzzy_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose detected titles agree, in either direction."""
    return titles.agreeing(_detected(spark, sf_dir))


def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their detected titles, and the titles that agree."""
    return titles.classes(_detected(spark, sf_dir))


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat("p_name", F.lit(" http://h.org/"), key, F.lit("?a=b. "), F.lit("see arXiv: 2001."), F.lpad(key, 5, "0"), F.lit("v2, "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.linked_parts(text)).alias("place", "p")).select("p_partkey", "place", "p.text", "p.url")


def section_search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, starts = F.array(*(F.lit(t) for t in ("Introduction", "Related Work", "Methods", "Conclusion"))), F.array(*(F.lit(k) for k in (1, 3, 5, 9)))
    k = F.col("o_orderkey")
    first = F.coalesce(F.when(k % 4 == 0, (k % 12).cast("string")), F.when(k % 4 == 1, F.lit(" work")), F.when(k % 4 == 2, F.lit("nothing")), F.lit(""))
    last = F.coalesce(F.when(k % 3 == 0, F.concat(F.lit(" + "), (k % 7).cast("string"))), F.when(k % 3 == 1, F.lit("CONCL")), (k % 13).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.search_range(first, last, names, starts, F.lit(10)).alias("r")).select("o_orderkey", F.col("r.from").alias("first_page"), F.col("r.to").alias("last_page"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.map_from_arrays(F.array(F.lit("Title"), F.lit("Author"), F.lit("Date")), F.array(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.metadata(facts)).alias("fact", "value"))


def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 30).alias("short"), T.base64_text(F.col("text").cast("binary"), "text/plain").alias("address"))


def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(T.clamp(q, F.lit(10.0), F.lit(40.0)), 6).alias("clamped"), F.round(T.fit_scale(q, p, F.lit(612.0), F.lit(792.0)), 6).alias("scale"), F.round(T.scroll_target(q, F.lit(792.0), p % 792, F.lit(1.5)), 6).alias("scroll"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    status = F.when(k % 5 == 0, 404).otherwise(200)
    kind = F.get(F.array(F.lit("application/pdf"), F.lit("Application/PDF; charset=x"), F.lit("text/html")), (k % 3).cast("int"))
    disposition = F.when(k % 4 == 1, "Attachment; filename=a.pdf")
    content = F.concat(F.when(k % 2 == 0, "%PDF-").otherwise("%PD"), "html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", files.acceptable(status, kind, disposition).alias("acceptable"), files.has_magic(content).alias("magic"))


def palette_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    return markup.nearest_color(table(spark, sf_dir, "part").select("p_partkey", color.alias("color")), "color").select("p_partkey", "color", "color_name")


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.first_heading(F.col("html")).alias("heading"), F.size(markup.links(F.col("html"))).alias("n_links"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.links(F.col("html"))).alias("place", "href"))


def search_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("start"))
    query = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("+ "), (F.col("o_orderkey") % 5).cast("string"))).otherwise((F.col("o_orderkey") % 11).cast("string"))
    return rows.select("o_orderkey", T.page_range(query, F.col("start"), F.lit(9)).alias("last_page"))


def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(T.truncate(glyphs.composed(T.clean_copy(F.col("text"))), 60)).alias("clip"))


def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmm"), F.lit("00Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.pdf_date(F.when(F.col("o_orderkey") % 3 > 0, value)).alias("shown"), T.shown_time(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate"))).alias("time"))


QUERIES = {f.__name__: f for f in (normalized_titles, normalized_part_names, url_fragments, url_file_names, number_expansion, year_lists, section_numbers, fuzzy_title_pairs, title_classes, reference_links, section_search_ranges, document_facts, shortened_texts, page_geometry, responses, palette_colors, page_headings, page_links, search_page_ranges, clipped_texts, pdf_dates)}

_NORM = "lower(regexp_replace(trim(regexp_replace({x}, '[^A-Za-z0-9\\s]', '', 'g'), ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g'))"
ORACLES = {
    "normalized_titles": f"SELECT doc_id, {_NORM.format(x='split_part(text, chr(10), 1)')} AS title FROM documents",
    "normalized_part_names": f"SELECT p_partkey, {_NORM.format(x='p_name')} AS title FROM part",
    "url_fragments": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS fragment FROM pages",
    "url_file_names": """SELECT page_id, CASE WHEN f = '' THEN 'document.pdf' WHEN lower(f) LIKE '%.pdf' THEN f ELSE f || '.pdf' END AS file_name
      FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS f FROM pages)""",
    "number_expansion": """WITH parts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        list_concat([l_linenumber::INT], list_concat(range(l_linenumber::INT, least(l_linenumber + (l_quantity % 7)::INT, l_linenumber + 30)::INT + 1), CASE WHEN l_linenumber * 400 < 1000 THEN [(l_linenumber * 400)::INT] ELSE [] END)) AS ns FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (unnest(range(len(ns))))::INT AS place, unnest(ns)::INT AS number FROM parts""",
    "year_lists": "SELECT o_orderkey, unnest([0, 1, 2])::INT AS place, unnest([year(o_orderdate) || 'a', year(o_orderdate) || 'b', year(o_orderdate)::VARCHAR]) AS year FROM orders",
    "section_numbers": "SELECT p_partkey, (p_size % 9 + 1) || '.' || (p_partkey % 5) AS prefix, 2 AS depth, p_name AS plain, (p_size % 9 + 1)::INT AS first_part FROM part",
    "title_classes": f"""WITH {TITLES_SQL}, heads AS (SELECT doc_id, {_NORM.format(x='title')} AS title FROM titles), w AS (SELECT title, min(doc_id) AS id, string_split(title, ' ') AS ws FROM heads WHERE title <> '' GROUP BY title),
      pairs AS (SELECT a.id AS a_id, b.id AS b_id, least(length(a.title), length(b.title)) >= 15 AND (CASE WHEN length(a.title) <= length(b.title) THEN starts_with(b.title, a.title) ELSE starts_with(a.title, b.title) END) AS begins,
        len(a.ws) >= 3 AND len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) >= 0.5 * len(a.ws) AS ab, len(b.ws) >= 3 AND len(list_filter(b.ws, lambda x: list_contains(a.ws, x))) >= 0.5 * len(b.ws) AS ba FROM w a JOIN w b ON a.id <= b.id)
      SELECT 'pair' AS kind, a_id, b_id, begins OR ab AS forward, begins OR ba AS backward FROM pairs WHERE a_id < b_id AND (begins OR ab OR ba)
      UNION ALL SELECT 'member', h.doc_id, p.a_id, begins OR ab, begins OR ba FROM heads h JOIN w ON w.title = h.title JOIN pairs p ON p.a_id = w.id AND p.b_id = w.id""",
    "fuzzy_title_pairs": f"""WITH {TITLES_SQL}, heads AS (SELECT doc_id, {_NORM.format(x='title')} AS title FROM titles), w AS (SELECT doc_id, title, string_split(title, ' ') AS ws FROM heads WHERE title <> ''),
      pairs AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, least(length(a.title), length(b.title)) >= 15 AND (CASE WHEN length(a.title) <= length(b.title) THEN starts_with(b.title, a.title) ELSE starts_with(a.title, b.title) END) AS begins,
        len(a.ws) >= 3 AND len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) >= 0.5 * len(a.ws) AS ab, len(b.ws) >= 3 AND len(list_filter(b.ws, lambda x: list_contains(a.ws, x))) >= 0.5 * len(b.ws) AS ba FROM w a JOIN w b ON a.doc_id < b.doc_id)
      SELECT a_id, b_id, begins OR ab AS forward, begins OR ba AS backward FROM pairs WHERE begins OR ab OR ba""",
    "reference_links": """WITH p AS (SELECT p_partkey, [p_name || ' ', 'http://h.org/' || p_partkey || '?a=b', '. see ', 'arXiv: 2001.' || lpad(p_partkey::VARCHAR, 5, '0') || 'v2', ', ' || p_brand] AS t, [NULL, 'http://h.org/' || p_partkey || '?a=b', NULL, 'https://arxiv.org/abs/2001.' || lpad(p_partkey::VARCHAR, 5, '0') || 'v2', NULL] AS u FROM part)
      SELECT p_partkey, unnest(range(5))::INT AS place, unnest(t) AS text, unnest(u) AS url FROM p""",
    "section_search_ranges": """WITH q AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 12 BETWEEN 1 AND 10 THEN o_orderkey % 12 ELSE 1 END WHEN 1 THEN 3 ELSE 1 END AS f FROM orders),
      t AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN least(f + o_orderkey % 7, 10) WHEN 1 THEN 9 ELSE CASE WHEN o_orderkey % 13 BETWEEN 1 AND 10 THEN o_orderkey % 13 END END AS l FROM q)
      SELECT o_orderkey, f::INT AS first_page, CASE WHEN l > f THEN l END::INT AS last_page FROM t""",
    "document_facts": """SELECT p_partkey, unnest(['Title', 'Author', 'Date']) AS fact, unnest([p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Unknown' END, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Unknown' END]) AS value FROM part""",
    "shortened_texts": "SELECT doc_id, CASE WHEN length(text) > 30 THEN text[1:30] || '...' ELSE text END AS short, 'data:text/plain;base64,' || to_base64(encode(text)) AS address FROM documents",
    "page_geometry": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(l_quantity, 10.0), 40.0), 6) AS clamped, round(least(612 / l_quantity, 792 / l_extendedprice), 6) AS scale, round(l_quantity + (792 - l_extendedprice % 792) * 1.5, 6) AS scroll FROM lineitem",
    "responses": "SELECT page_id, page_id % 5 <> 0 AND page_id % 3 < 2 AND page_id % 4 <> 1 AS acceptable, page_id % 2 = 0 AS magic FROM pages",
    "palette_colors": f"""WITH c AS (SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS color, (p_partkey * 7919 % 16777216) AS v FROM part),
      p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:], 16)})" for i, (n, h) in enumerate(markup.PALETTE))}) t(ord, color_name, r, g, b))
      SELECT p_partkey, color, arg_min(color_name, ((v // 65536 - r) ** 2 + (v // 256 % 256 - g) ** 2 + (v % 256 - b) ** 2) * 10 + ord) AS color_name FROM c, p GROUP BY 1, 2""",
    "page_headings": """WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS t, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n FROM pages)
      SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS heading, n AS n_links FROM h""",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(len(h)))::INT AS place, replace(unnest(h), '&amp;', '&') AS href FROM l""",
    "search_page_ranges": """WITH q AS (SELECT o_orderkey, (o_orderkey % 7 + 1)::INT AS s, least(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 + 1 + o_orderkey % 5 ELSE o_orderkey % 11 END, 9)::INT AS t FROM orders)
      SELECT o_orderkey, CASE WHEN t > s THEN t END AS last_page FROM q""",
    "clipped_texts": """WITH c AS (SELECT doc_id, nfc_normalize(replace(replace(text, chr(10), ' '), '- ', '')) AS t FROM documents), k AS (SELECT doc_id, CASE WHEN length(t) > 60 THEN t[1:59] || '…' ELSE t END AS t FROM c)
      SELECT doc_id, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS clip FROM k""",
    "pdf_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE 'Unknown' END AS shown, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE 'Unknown' END AS time FROM orders",
}
