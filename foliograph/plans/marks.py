"""Queries over strokes, marks, comments and page candidates, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.folds import cut
from foliograph.operators import annotations as A
from foliograph.operators import references as R
from foliograph.sources import files
from foliograph.sources.adapters import LINES_SQL, lines, table


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items as the points of a stroke, in the order of all columns."""
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select("l_orderkey", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("points"))


def stroke_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strokes(spark, sf_dir).select("l_orderkey", F.posexplode(A.simplified(F.col("points"), 0.1)).alias("place", "p")).select("l_orderkey", "place", "p.x", "p.y")


def brush_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strokes(spark, sf_dir).select("l_orderkey", F.posexplode(A.lazy_brush(F.col("points"), 0.2)).alias("place", "p")).select("l_orderkey", "place", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def stroke_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {c: F.col("points").getField(c) for c in "xy"}
    return _strokes(spark, sf_dir).select("l_orderkey", *(f(at[c]).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))))


def color_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("section_id"), F.col("p_partkey").alias("mark_id"), F.col("p_brand").alias("color"))
    return A.color_dots(marks)


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with frames and embeds by their key; every seventh one is a file itself."""
    k = F.col("page_id")
    url = F.when(k % 7 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".PDF?x"))).otherwise(F.col("url"))
    embed, frame, known = F.lit('<embed src="e.x" type="application/pdf">'), F.lit('<iframe class=a src="https://x.org/v/My.PDF?y"></iframe><iframe src="https://pdf.org/none"></iframe>'), F.lit('<IFRAME src="shown" id="pdf-iframe">')
    more = F.get(F.array(F.lit(""), embed, F.concat(embed, frame), F.concat(embed, frame, known)), (k % 4).cast("int"))
    return files.candidates(table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat("html", more).alias("html")))


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_gaps(lines(spark, sf_dir))


def structural_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(lines(spark, sf_dir))  # typeset once for four passes
    width = rows.groupBy("doc_id").agg(F.percentile("w", 0.5).alias("body_width"))
    known = rows.join(R.line_gaps(rows), "doc_id").join(width, "doc_id").join(R.layouts(rows), "doc_id").withColumn("author_year", F.lit(False))
    return R.shaped_entries(known)


def wide_gap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of lines of one width and edge, of which every fourth stands off: the rules of gaps and of new pages."""
    rows = lines(spark, sf_dir).withColumns({"y": 700.0 - 18.0 * (F.col("line_no") % 40) - 9.0 * F.floor(F.col("line_no") % 40 / 4), "x": F.lit(72.0), "w": F.lit(300.0), "text": F.concat(F.lit("plain "), "text")})
    return R.shaped_entries(rows.withColumns({"gap": F.lit(18.0), "body_width": F.lit(300.0), "straight": F.lit(False), "author_year": F.lit(False)}))


QUERIES = {f.__name__: f for f in (stroke_simplify, brush_positions, stroke_bounds, color_dots, page_candidates, line_gaps, structural_entries, wide_gap_entries)}
_POINTS = "points AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity / 50, l_discount * 10) - 1)::INT AS k, l_quantity / 50 AS x, l_discount * 10 AS y FROM lineitem)"
ORACLES = {
    # the parts of a stroke between points that stay, each split at its farthest point beyond the tolerance
    "stroke_simplify": f"""WITH RECURSIVE {_POINTS}, seg AS (SELECT l_orderkey, 0 AS a, max(k) AS b, 0 AS depth FROM points GROUP BY 1
        UNION ALL SELECT l_orderkey, unnest([a, far]) AS a, unnest([far, b]) AS b, depth + 1 FROM (
          SELECT s.l_orderkey, s.a, s.b, s.depth, arg_min(p.k, (-(CASE WHEN pa.x = pb.x AND pa.y = pb.y THEN sqrt((p.x - pa.x) ** 2 + (p.y - pa.y) ** 2) ELSE abs((pb.y - pa.y) * (p.x - pa.x) - (pb.x - pa.x) * (p.y - pa.y)) / sqrt((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2) END), p.k)) AS far,
            max(CASE WHEN pa.x = pb.x AND pa.y = pb.y THEN sqrt((p.x - pa.x) ** 2 + (p.y - pa.y) ** 2) ELSE abs((pb.y - pa.y) * (p.x - pa.x) - (pb.x - pa.x) * (p.y - pa.y)) / sqrt((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2) END) AS off
          FROM seg s JOIN points pa ON pa.l_orderkey = s.l_orderkey AND pa.k = s.a JOIN points pb ON pb.l_orderkey = s.l_orderkey AND pb.k = s.b JOIN points p ON p.l_orderkey = s.l_orderkey AND p.k > s.a AND p.k < s.b GROUP BY 1, 2, 3, 4) WHERE off > 0.1),
      kept AS (SELECT l_orderkey, a AS k FROM seg UNION SELECT l_orderkey, b FROM seg)
      SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1)::INT AS place, x, y FROM kept JOIN points USING (l_orderkey, k)""",
    "brush_positions": f"""WITH RECURSIVE {_POINTS}, brush AS (SELECT l_orderkey, k, x, y FROM points WHERE k = 0
        UNION ALL SELECT p.l_orderkey, p.k, CASE WHEN d > 0.2 THEN b.x + (p.x - b.x) * (d - 0.2) / d ELSE b.x END, CASE WHEN d > 0.2 THEN b.y + (p.y - b.y) * (d - 0.2) / d ELSE b.y END FROM brush b JOIN points p ON p.l_orderkey = b.l_orderkey AND p.k = b.k + 1, LATERAL (SELECT sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2) AS d))
      SELECT l_orderkey, k AS place, round(x, 6) AS x, round(y, 6) AS y FROM brush""",
    "stroke_bounds": "SELECT l_orderkey, min(l_quantity / 50) AS min_x, max(l_quantity / 50) AS max_x, min(l_discount * 10) AS min_y, max(l_discount * 10) AS max_y FROM lineitem GROUP BY 1",
    "color_dots": """WITH c AS (SELECT p_partkey % 97 AS section_id, p_brand AS color, min(p_partkey) AS f, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY f) AS nth FROM c)
      SELECT section_id, string_agg(color, ',' ORDER BY f) FILTER (nth <= 3) AS colors, greatest(sum(n) - 3, 0)::BIGINT AS extra FROM r GROUP BY 1""",
    "page_candidates": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '[?#].*$', '') || '.PDF?x' ELSE [NULL, 'e.x', 'https://x.org/v/My.PDF?y', 'shown'][page_id % 4 + 1] END AS candidate FROM pages",
    # the first lines of pages after the first leap there without evidence
    "wide_gap_entries": f"WITH {LINES_SQL} SELECT doc_id, line_no, (1 + sum(CASE WHEN line_no % 4 = 0 AND line_no % 40 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS entry FROM lines",
    # a document's lines one after the other, with the entry, its left edge and the direction as a state
    "structural_entries": f"""WITH RECURSIVE {LINES_SQL}, gaps AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY line_no)) AS g FROM lines),
      s AS (SELECT * FROM lines WHERE length(trim(text)) > 10), m AS (SELECT doc_id, count(*) AS n, list_sort(list(w))[greatest(ceil(0.9 * count(*)), 1)::INT] AS wide, median(h) AS height FROM s GROUP BY 1),
      flat AS (SELECT doc_id, any_value(n) >= 5 AND count(*) FILTER (w >= 0.5 * wide AND abs(w - wide) < 3 * height) >= 0.7 * count(*) FILTER (w >= 0.5 * wide) AS straight FROM s JOIN m USING (doc_id) GROUP BY 1),
      known AS (SELECT l.doc_id, coalesce(median(CASE WHEN g > 0 AND g < 4 * h THEN g END), 0) AS gap, median(w) AS body, coalesce(any_value(straight), false) AS straight FROM gaps l LEFT JOIN flat f ON f.doc_id = l.doc_id GROUP BY 1),
      seen AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_x FROM lines),
      told AS (SELECT doc_id, line_no, x, h AS reach, lag(x) OVER d AS last_x, y - lag(y) OVER d AS step, gap, page_no <> lag(page_no) OVER d AS turned, (lag(w) OVER d < body - 2 * h)::INT AS short, straight::INT AS straight, coalesce(next_x - x > 2, false)::INT AS inset, row_number() OVER d AS nth,
          (regexp_matches(trim(text), '^[A-Z][a-zÀ-ÿ]+[,\\s]+[A-Z].*(?:19|20)[0-9]{{2}}') OR regexp_matches(trim(text), '^[\\[(]?[A-Z]*\\+?[0-9]+[\\]).]') OR regexp_matches(trim(text), '^[A-Z][a-zÀ-ÿ]+[,.]'))::INT AS begins
        FROM seen JOIN known USING (doc_id) WHERE length(trim(text)) > 2 WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
      st AS (SELECT doc_id, nth, line_no, 1 AS entry, x AS edge, 0.0::DOUBLE AS course FROM told WHERE nth = 1
        UNION ALL SELECT doc_id, nth, line_no, entry + opens::INT, CASE WHEN opens THEN x ELSE edge END, CASE WHEN leap THEN 0 WHEN step <> 0 THEN sign(step) ELSE course END FROM (
          SELECT *, CASE WHEN leap THEN short + inset > 0 WHEN abs(step) > 1.3 * gap THEN true WHEN x <= edge + reach AND last_x >= edge + reach THEN short + begins > 0 WHEN short = 1 THEN straight + begins > 0 WHEN x <= edge + reach THEN begins > straight ELSE false END AS opens
          FROM (SELECT t.*, st.entry, st.edge, st.course, t.turned OR (abs(t.step) > t.gap AND sign(t.step) * st.course < 0) AS leap FROM st JOIN told t ON t.doc_id = st.doc_id AND t.nth = st.nth + 1)))
      SELECT doc_id, line_no, entry FROM st""",
    "line_gaps": f"""WITH {LINES_SQL}, g AS (SELECT doc_id, h, abs(y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY line_no)) AS gap FROM lines)
      SELECT doc_id, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0 AND gap < 4 * h), 0.0) AS gap FROM g GROUP BY 1""",
}
