"""Queries from characters to lines, headers and footers, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import glyphs as G
from foliograph.sources.adapters import LINES_SQL, lines, table


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part a page: its name, size and key, with an accent of its own and two characters of a script without blanks."""
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mm, "), F.col("p_partkey").cast("string"), F.lit("é\n漢字"))
    each = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(text, "")).alias("idx", "c")).where("c <> ''")
    left = F.when(~F.col("c").isin(" ", "\n"), F.col("idx") * 6.0)
    return each.select("doc_id", F.lit(1).alias("page_no"), "idx", F.ascii("c").alias("code"), left.alias("left"), F.lit(100.0).alias("bottom"), (left + 5).alias("right"), F.lit(110.0).alias("top"), F.lit(9.0).alias("font_size"), F.lit("Times-BoldItalic").alias("font_family"))


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.runs(_chars(spark, sf_dir)).drop("page_no", "font_family")


def composed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_texts(_chars(spark, sf_dir))


def char_range_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _chars(spark, sf_dir)
    ranges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("p_partkey") % 3).alias("range_no"), (F.col("p_partkey") % 3).alias("begin"), F.lit(4).alias("length"))
    return G.char_range_rects(chars, ranges)


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs, three a line, a little out of line with each other, in four fonts."""
    from foliograph.plans.places import _rects

    no = F.col("no") - 1
    family = F.get(F.array(*(F.lit(f) for f in ("Times", "Times-Bold", "CMTI10-Oblique", "SFSX1000-Slanted"))), (F.col("doc_id") % 4).cast("int"))
    return _rects(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), no.cast("int").alias("slice_no"), F.concat(F.lit("w"), F.col("no").cast("string"), F.lit(" ")).alias("content"), (50.0 * (no % 3)).alias("x"), (700.0 - 14.0 * F.floor(no / 3) + no % 3).alias("y"), F.lit(40.0).alias("w"), (8.0 + no % 3).alias("h"), (9.0 + no % 2).alias("font_size"), family.alias("font_family"))


def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lines_of(_slices(spark, sf_dir))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rules: an order is a document, a line number a page."""
    bottom = F.when(F.col("l_suppkey") % 2 == 0, 690.0 + 10 * (F.col("l_partkey") % 3)).otherwise(60.0 + 10 * (F.col("l_partkey") % 6))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(50.0).alias("left"), bottom.alias("bottom"), (50.0 + 100 * (F.col("l_quantity") % 7)).alias("right"), (bottom + F.col("l_quantity") % 4).alias("top"), F.when(F.col("l_partkey") % 2 == 0, "path").otherwise("image").alias("kind"), (F.col("l_quantity") % 3).cast("int").alias("segments"), F.lit(1).alias("moves"))


def page_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.separators(_paths(spark, sf_dir))


def band_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.band_heights(G.separators(_paths(spark, sf_dir)))


def line_like_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.line_like_paths(_paths(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    seps = rows.select("doc_id", "page_no").distinct().where("page_no % 2 = 0").select("doc_id", "page_no", F.lit(700.0).alias("header_sep_y"), F.lit(None).cast("double").alias("footer_sep_y"))
    return G.banded(rows, seps).where("band is not null").select("doc_id", "line_no", "band")


def soft_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("￾\n")), F.lit("￾"), F.col("p_partkey").cast("string"))
    rows = G.without_soft_hyphens(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    return rows.select("p_partkey", "clean", G.original_place(F.length("clean"), F.col("gaps")).alias("end_place"), G.original_place(F.lit(1), F.col("gaps")).alias("second_place"))


QUERIES = {f.__name__: f for f in (text_runs, composed_pages, char_range_rects, glyph_lines, page_separators, band_heights, line_like_paths, line_bands, soft_hyphens)}

_TEXTS = "texts AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_size || 'mm, ' || p_partkey || 'e' || chr(769) || chr(10) || '漢字' AS t FROM part)"
_SLICES = """n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS no FROM lineitem)"""
_PATHS = """paths AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_suppkey % 2 = 0 THEN 690.0 + 10 * (l_partkey % 3) ELSE 60.0 + 10 * (l_partkey % 6) END::DOUBLE AS bottom, (100 * (l_quantity % 7))::DOUBLE AS wide, (l_quantity % 4)::DOUBLE AS high, CASE WHEN l_partkey % 2 = 0 THEN 'path' ELSE 'image' END AS kind, (l_quantity % 3)::INT AS segments FROM lineitem),
rules AS (SELECT *, CASE WHEN high < 3 AND wide > 0.6 * 612 AND bottom > 0.85 * 792 THEN bottom END AS up, CASE WHEN high < 3 AND wide > 0.6 * 612 AND bottom + high < 0.15 * 792 THEN bottom + high END AS down FROM paths),
seps AS (SELECT doc_id, page_no, list_sort(list(up) FILTER (up IS NOT NULL))[count(up) // 2 + 1] AS header_sep_y, list_sort(list(down) FILTER (down IS NOT NULL))[count(down) // 2 + 1] AS footer_sep_y FROM rules GROUP BY 1, 2)"""
ORACLES = {
    "text_runs": f"""WITH {_TEXTS}, r AS (SELECT doc_id, regexp_extract_all(t, '[0-9]+\\s*|[\\x{{4e00}}-\\x{{9fff}}]\\s*|[^0-9\\s\\x{{4e00}}-\\x{{9fff}}]+\\s*') AS rs FROM texts),
      e AS (SELECT doc_id, unnest(range(len(rs))) AS k, rs FROM r)
      SELECT doc_id, k::INT AS slice_no, rs[k + 1] AS content, (6 * length(array_to_string(rs[1:k], '')))::DOUBLE AS x, 110.0::DOUBLE AS y, (6 * length(regexp_replace(rs[k + 1], '\\s+$', '')) - 1)::DOUBLE AS w, 10.0::DOUBLE AS h, 9.0::DOUBLE AS font_size FROM e""",
    "composed_pages": f"WITH {_TEXTS} SELECT doc_id, 1 AS page_no, nfc_normalize(t) AS page_text FROM texts",
    "char_range_rects": f"""WITH {_TEXTS}, c AS (SELECT doc_id, t, unnest(range(doc_id % 3, doc_id % 3 + 4)) AS i FROM texts)
      SELECT doc_id, 1 AS page_no, doc_id % 3 AS range_no, 0 AS part, (6 * min(i))::DOUBLE AS x, 682.0::DOUBLE AS y, (6 * (max(i) - min(i)) + 5)::DOUBLE AS w, 10.0::DOUBLE AS h FROM c WHERE t[i + 1] NOT IN (' ', chr(10)) GROUP BY 1, 3""",
    "glyph_lines": f"""WITH {_SLICES}, g AS (SELECT doc_id, no // 3 AS l, count(*) AS n FROM n GROUP BY 1, 2)
      SELECT doc_id, 1 AS page_no, l::INT AS line_no, array_to_string([ 'w' || (3 * l + k) || ' ' for k in range(1, n + 1)], '') AS text, 0.0::DOUBLE AS x, (700 - 14 * l)::DOUBLE AS y, (792 - (700 - 14 * l + (n - 1) // 2) + 1)::DOUBLE AS original_y, (50 * (n - 1) + 40)::DOUBLE AS w, (8 + n // 2)::DOUBLE AS h,
        list_sort([(9 + (3 * l + k) % 2) for k in range(0, n)])[(n // 2 + 1)::INT]::DOUBLE AS font_size, [0, 1, 2, 3][doc_id % 4 + 1] AS style FROM g""",
    "page_separators": f"WITH {_PATHS} SELECT * FROM seps",
    "band_heights": f"""WITH {_PATHS}, few AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS nth FROM seps WHERE page_no <> 1),
      e AS (SELECT doc_id, page_no, 'h' AS k, 792 - header_sep_y AS v FROM few WHERE nth <= 10 AND header_sep_y IS NOT NULL UNION ALL SELECT doc_id, page_no, 'f', footer_sep_y FROM few WHERE nth <= 10 AND footer_sep_y IS NOT NULL),
      c AS (SELECT doc_id, k, v, count(*) AS n, min(page_no) AS f FROM e GROUP BY 1, 2, 3), m AS (SELECT doc_id, k, arg_min(v, (-n, f)) AS v, sum(n) AS total FROM c GROUP BY 1, 2)
      SELECT d.doc_id, coalesce(max(v) FILTER (k = 'h' AND total >= 2), 0.0)::DOUBLE AS header_height, coalesce(max(v) FILTER (k = 'f' AND total >= 2), 0.0)::DOUBLE AS footer_height FROM (SELECT DISTINCT doc_id FROM seps) d LEFT JOIN m USING (doc_id) GROUP BY 1""",
    "line_like_paths": f"WITH {_PATHS} SELECT doc_id, kind, count(*) AS n FROM paths WHERE (kind = 'path' AND segments = 2) OR (kind = 'image' AND high < 3 AND wide > 20) GROUP BY 1, 2",
    "line_bands": f"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN y > CASE WHEN page_no % 2 = 0 THEN 700 ELSE 0.9 * 792 END THEN 'header' ELSE 'footer' END AS band FROM lines WHERE length(trim(text)) <= 120 AND w <= 0.7 * 612 AND (y > CASE WHEN page_no % 2 = 0 THEN 700 ELSE 0.9 * 792 END OR y < 0.1 * 792)""",
    "soft_hyphens": "SELECT p_partkey, replace(p_name, ' ', '') || p_partkey AS clean, (length(p_name) + length(p_partkey::VARCHAR) + 1 + len(string_split(p_name, ' ')) - 1)::INT AS end_place, (CASE WHEN strpos(p_name, ' ') = 2 THEN 3 ELSE 1 END)::INT AS second_place FROM part",
}
