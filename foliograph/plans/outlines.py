"""Queries over headings, outlines and reference sections, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions.folds import cut
from foliograph.operators import citations, layout, outline, references, trees
from foliograph.plans.layout import METRICS_SQL
from foliograph.sources.adapters import LINES_SQL, lines, table

_TITLE = "concat(upper(left({t}, 1)), lower(substr({t}, 2)))"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typeset lines with every seventh one as a heading of some kind: numbered, in capitals, large, of two capitalised words,
    a common name, a caption, the abstract, references, an appendix, or too long a number."""
    rows, k = lines(spark, sf_dir), F.floor(F.col("line_no") / 7).cast("int")
    n, m = (k % 9 + 1).cast("string"), (k % 4 + 1).cast("string")
    made = (F.concat(n, F.lit(" First Part")), F.concat(n, F.lit("."), m, F.lit(" Second part")), F.concat(F.lit("IV. THIRD PART")), F.lit("A Large One"), F.lit("Related Work"), F.lit("Figure 3 And More"), F.lit("Abstract"), F.lit("References"), F.lit("Appendix B Proofs"), F.concat(n, F.lit(" lower case")), F.concat(F.lit("50"), n, F.lit(" Too Large")))
    at = F.col("line_no") % 7 == 3
    text = F.coalesce(*(F.when(k % len(made) == i, t) for i, t in enumerate(made)))
    one = F.when(at, text).otherwise(F.col("text"))
    high = F.when(at, F.get(F.array(*(F.lit(x) for x in (14.0, 12.0, 10.0, 16.0, 10.0, 16.0, 11.0, 13.0, 12.0, 12.0, 12.0))), k % len(made))).otherwise(F.col("h"))
    return rows.withColumns({"text": one, "h": high, "w": 5.0 * F.length(one), "style": F.when(at, F.when(k % 5 == 2, 0).otherwise(1)).otherwise(F.col("style"))})


HEADED_SQL = f"""{LINES_SQL}, k AS (SELECT *, (line_no // 7)::INT AS k, line_no % 7 = 3 AS at_heading FROM lines),
texts AS (SELECT *, CASE WHEN at_heading THEN [(k % 9 + 1) || ' First Part', (k % 9 + 1) || '.' || (k % 4 + 1) || ' Second part', 'IV. THIRD PART', 'A Large One', 'Related Work', 'Figure 3 And More', 'Abstract', 'References', 'Appendix B Proofs', (k % 9 + 1) || ' lower case', '50' || (k % 9 + 1) || ' Too Large'][k % 11 + 1] ELSE text END AS made,
  CASE WHEN at_heading THEN [14.0, 12.0, 10.0, 16.0, 10.0, 16.0, 11.0, 13.0, 12.0, 12.0, 12.0][k % 11 + 1] ELSE h END::DOUBLE AS high FROM k)"""
_HEADED = f"{HEADED_SQL}, headed AS (SELECT doc_id, line_no, page_no, made AS text, x, y, (5.0 * length(made))::DOUBLE AS w, high AS h, CASE WHEN at_heading THEN CASE WHEN k % 5 = 2 THEN 0 ELSE 1 END ELSE style END AS style, k, at_heading FROM texts)"
_METRICS = METRICS_SQL.replace("FROM lines", "FROM headed")
_FOUND = f"""{_HEADED}, {_METRICS},
judged AS (SELECT h.*, m.line_height AS body, w < m.line_width AS short, style = 1 AS bold, floor(100 * h) + 50 < floor(100 * m.line_height) AS smaller, text = upper(text) AS capitals, h > 1.4 * m.line_height AS tall,
  regexp_extract(trim(text), '^([0-9]+(?:\\.[0-9]+)*|[A-Z](?:\\.[0-9]+)?|[IVXLCDM]+)\\.?\\s+\\S', 1) AS prefix FROM headed h JOIN metrics m USING (doc_id) WHERE length(trim(text)) BETWEEN 5 AND 100 AND h <= 40),
words AS (SELECT *, regexp_split_to_array(trim(text), '[\\s.]+') AS ws FROM judged),
found AS (SELECT *, CASE WHEN prefix <> '' THEN CASE WHEN (bold OR capitals) AND NOT smaller AND regexp_replace(regexp_replace(trim(text), '^(?:[0-9]+(?:\\.[0-9]+)*\\.?|[A-Z]\\.(?:[0-9]+(?:\\.[0-9]+)*\\.?)?|[IVXLCDM]+\\.)\\s+', ''), '\\s', '', 'g')[1] BETWEEN 'A' AND 'Z' THEN 'numbered' END
  WHEN tall AND bold AND short AND length(trim(text)) < 80 THEN 'large'
  WHEN NOT smaller AND short AND bold AND length(text) >= 5 AND len(ws) >= 2 AND len(list_filter(ws, lambda x: x[1] BETWEEN 'A' AND 'Z')) >= 0.6 * len(ws) THEN 'title_case'
  WHEN short AND trim(text) IN ('Abstract', 'References', 'Related Work') THEN 'common' END AS kind FROM words WHERE NOT regexp_matches(lower(trim(text)), '^(tab|fig|sec|keywords)')),
headings AS (SELECT doc_id, page_no, line_no, text, x, y, h, prefix, CASE WHEN prefix = '' THEN 0 ELSE len(string_split(prefix, '.')) END::INT AS depth, kind FROM found WHERE kind IS NOT NULL)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(headed(spark, sf_dir))  # typeset once for the metrics and the headings
    return layout.headings(rows, layout.body_metrics(rows))


def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.leveled(_found(spark, sf_dir)).select("doc_id", "line_no", "tier", "level")


def abstract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headed(spark, sf_dir)
    return layout.abstracts(rows, layout.body_metrics(rows))


def _outline(spark: SparkSession, sf_dir: str, typeset: DataFrame | None = None) -> DataFrame:
    """Headings as outlines: a document's headings, each the child of the last one of its first kind."""
    rows = (headed(spark, sf_dir) if typeset is None else typeset).where("line_no % 7 = 3")
    node = F.col("line_no").cast("long")
    parent = F.when(F.floor(F.col("line_no") / 7) % 11 != 0, (F.floor(F.floor(F.col("line_no") / 7) / 11) * 77 + 3).cast("long"))
    return rows.select("doc_id", node.alias("node_id"), parent.alias("parent_id"), F.col("line_no").alias("ord"), F.col("text").alias("title"), (F.col("page_no") - 1).alias("page_index"), F.col("x").alias("left"), F.col("y").alias("top"))


_OUTLINE = f"{_HEADED}, outlines AS (SELECT doc_id, line_no::BIGINT AS node_id, CASE WHEN k % 11 <> 0 THEN ((k // 11) * 77 + 3)::BIGINT END AS parent_id, line_no AS ord, text AS title, (page_no - 1)::INT AS page_index, x AS \"left\", y AS top FROM headed WHERE at_heading)"


def outlines_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines with every fifth line as a figure and every eleventh as a note below the sections that contain them."""
    asked = "line_no % 5 = 1 OR line_no % 11 = 2"
    rows = cut(headed(spark, sf_dir).where(f"line_no % 7 = 3 OR {asked}").select("doc_id", "line_no", "page_no", F.when(F.col("line_no") % 7 == 3, F.col("text")).alias("text"), "x", "y"))
    k = F.col("line_no")
    items = rows.where(asked).select("doc_id", k.cast("long").alias("item_no"), F.when(k % 5 == 1, "Figure").otherwise("Note").alias("title"), (F.col("page_no") - 1).alias("page_index"), F.col("x").alias("left"), F.col("y").alias("top"))
    return outline.inserted(_outline(spark, sf_dir, rows), items)


def section_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.section_targets(_outline(spark, sf_dir)).drop("x", "y")


def chosen_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _outline(spark, sf_dir)
    return outline.chosen(every.where("doc_id % 3 <> 0"), every.withColumn("title", F.concat(F.lit("found: "), "title"))).select("doc_id", "node_id", "parent_id", "title")


def purged_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _outline(spark, sf_dir).withColumn("title", F.when(F.col("parent_id").isNull() & (F.col("doc_id") % 2 == 0), "3 Bibliography").otherwise(F.col("title")))
    below = every.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("ancestor"), "node_id")
    return outline.purged(every, below).select("doc_id", "node_id")


def outlines_with_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _outline(spark, sf_dir).where("title <> 'Abstract' OR doc_id % 2 = 0")
    abstracts = every.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page_no"), F.lit(72.0).alias("x"), F.lit(690.0).alias("y"))
    return outline.with_abstract(every, abstracts).select("doc_id", "node_id", "ord", "title")


def document_title_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.when(F.col("p_partkey") % 3 > 0, F.left("p_type", (F.col("p_partkey") % 20).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", outline.document_title(F.col("p_name"), recorded).alias("title"))


def nearest_heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(headed(spark, sf_dir).select("doc_id", "page_no", "line_no", "x", "y"))
    points = rows.where("line_no % 5 = 0").select("doc_id", "page_no", F.col("line_no").alias("point_no"), (F.col("x") + 7).alias("x"), (F.col("y") - 8.5).alias("y"))
    return outline.nearest_lines(points, rows)


def _bookmarks(rows: DataFrame) -> DataFrame:
    """Bookmarks without a place: all headings but some, and, with long titles, lines without their last word and the halves of others."""
    at, half = F.col("line_no") % 7, F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    title = F.when((at == 3) & ~F.col("text").contains("lower"), F.col("text")).when(at == 5, F.regexp_replace("text", " [^ ]*$", "")).when(at == 1, half)
    node = F.col("line_no").cast("long")
    return rows.select("doc_id", node.alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("line_no").alias("ord"), title.alias("title"), F.lit(0).alias("page_index"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top")).where("title IS NOT NULL")


def located_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bookmark's line. Every eleventh line is in bold, so that halves of such lines' words name them."""
    plain = cut(headed(spark, sf_dir))
    rows = plain.withColumn("style", F.when(F.col("line_no") % 11 == 1, 1).otherwise(F.col("style")))
    return outline.located(_bookmarks(rows), rows, layout.body_metrics(plain))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "page_no", F.col("line_no").alias("ord"), "x", "y", F.when(F.col("line_no") % 9 == 0, -1).when(F.col("x") > 300, 1).otherwise(0).alias("column"))
    return outline.reading_order(rows).select("doc_id", "ord", "band", "place")


def column_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    edges = layout.columns(rows).select("doc_id", "page_no", F.when(F.col("multi_column"), F.array("left_x", "right_x")).otherwise(F.array("left_x")).alias("edges"))
    return rows.join(edges, ["doc_id", "page_no"]).select("doc_id", "line_no", layout.column_index(F.col("x"), F.col("edges")).alias("column_no"))


def _ending(rows: DataFrame, which: str = "true") -> DataFrame:
    """Lines of the documents that ``which`` holds for with numbered entries at the end, three lines each."""
    last = rows.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    from_end = F.col("last") - F.col("line_no")
    numbered = F.concat(F.lit("["), (5 - F.floor(from_end / 3)).cast("string"), F.lit("] "), "text")
    return rows.join(last, "doc_id").withColumn("text", F.when(F.expr(which) & (from_end % 3 == 2) & (from_end < 15), numbered).otherwise(F.col("text"))).drop("last")


def reference_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents by all three tiers: some have an outline that names one, some a heading, and of every third one the
    headings are taken away and its last lines are numbered entries."""
    plain = cut(headed(spark, sf_dir))
    rows = plain.withColumn("text", F.when((F.col("doc_id") % 3 == 1) & (F.col("text") == "References"), "Remarks").otherwise(F.col("text")))
    by_outline = _outline(spark, sf_dir).where("doc_id % 3 = 0 AND doc_id % 2 = 0 AND page_index >= 3")
    return references.sections(cut(_ending(rows, "doc_id % 3 = 1")), by_outline, layout.body_metrics(plain))


def probed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of a document as numbered entries, three lines each: found from the end."""
    return references.starts_by_probe(cut(_ending(cut(lines(spark, sf_dir)))))


def line_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.layouts(lines(spark, sf_dir))


def bounding_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.plans.places import _rects

    rows = cut(_rects(spark, sf_dir).select("doc_id", "page_no", "no", "rect.x", "rect.y"))
    anchors = rows.where("no % 2 = 1").withColumnRenamed("no", "ref_ord")
    spans = rows.where("no % 2 = 1").select("doc_id", F.col("no").alias("ref_ord"), ((F.col("page_no") + 1) % 3).alias("page_no"))
    return references.bounding_anchors(rows.where("no % 2 = 0").withColumnRenamed("no", "point_no"), anchors, spans)


def entry_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.plans.places import _rects

    rows = _rects(spark, sf_dir).select("doc_id", F.floor(F.col("no") / 3).alias("ref_ord"), "page_no", F.col("no").alias("line_no"), "rect.*")
    return references.page_rects(rows).select("doc_id", "ref_ord", "page_no", F.size("rects").alias("n"), F.col("rects")[0]["x"].alias("first_x"), F.element_at("rects", -1)["y"].alias("last_y"))


def entry_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    entries = rows.select("doc_id", "line_no", F.floor(F.col("line_no") / 3).alias("entry"))
    return citations.entry_anchors(rows, entries).select("doc_id", "entry", "page_no", "start_x", "start_y", "end_x", "end_y", "text", "has_multiple_authors")


def heading_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    of = rows.where("line_no = 0")
    ends = of.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("page_no"), F.lit(700.5).alias("y"), F.lit(14.0).alias("h"))
    abstracts = of.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 4 / 2 + 1).cast("int").alias("page_no"), F.lit(650.0).alias("y"))
    return layout.heading_region(rows, ends, abstracts).select("doc_id", "line_no")


def distinct_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.operators import links
    from foliograph.plans.places import _rects

    rows = _rects(spark, sf_dir).select("doc_id", F.col("no").alias("ord"), (F.col("no") % 2).alias("dest_page"), (F.col("rect.y") / 21).alias("dest_y"))
    return links.distinct_figures(rows).select("doc_id", "ord")


def usable_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.usable(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliograph.plans.places import _tree

    return trees.subtree_pairs(_tree(spark, sf_dir)).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


def normalized_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headed(spark, sf_dir).where("line_no % 7 = 3").select("doc_id", "line_no", T.normalize_heading(F.col("text")).alias("heading"), T.appendix_letter(F.col("text")).alias("letter"))


QUERIES = {f.__name__: f for f in (heading_candidates, heading_levels, abstract_lines, outlines_with_items, section_targets, chosen_outlines, purged_outlines, outlines_with_abstract, document_title_choice, nearest_heading_lines, located_bookmarks, reading_order, column_of_lines, reference_sections, probed_sections, line_layouts, bounding_anchors, entry_rects, entry_anchors, heading_regions, distinct_figures, usable_indexes, tree_descendants, normalized_headings)}

ORACLES = {
    "heading_candidates": f"WITH {_FOUND} SELECT * FROM headings",
    "heading_levels": f"""WITH RECURSIVE {_FOUND}, sized AS (SELECT doc_id, line_no, depth, floor(h * 10 + 0.5) / 10 AS s FROM headings),
      a AS (SELECT doc_id, max(s) AS top, 0 AS tier FROM sized GROUP BY 1 UNION ALL SELECT a.doc_id, (SELECT max(s.s) FROM sized s WHERE s.doc_id = a.doc_id AND s.s < a.top * 0.9) AS top, a.tier + 1 FROM a WHERE (SELECT max(s.s) FROM sized s WHERE s.doc_id = a.doc_id AND s.s < a.top * 0.9) IS NOT NULL),
      t AS (SELECT s.*, max(a.tier) AS tier FROM sized s JOIN a ON a.doc_id = s.doc_id AND s.s <= a.top GROUP BY ALL),
      b AS (SELECT doc_id, tier, min(depth) FILTER (depth > 0) AS least, coalesce(max(depth) FILTER (depth > 0) - min(depth) FILTER (depth > 0), 0) + 1 AS room FROM t GROUP BY 1, 2),
      c AS (SELECT *, 1 + coalesce(sum(room) OVER (PARTITION BY doc_id ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b)
      SELECT doc_id, line_no, tier, (base + CASE WHEN depth > 0 THEN depth - least ELSE 0 END)::INT AS level FROM t JOIN c USING (doc_id, tier)""",
    "abstract_lines": f"WITH {_HEADED} SELECT doc_id, arg_min(page_no, line_no) AS page_no, min(line_no) AS line_no, arg_min(x, line_no) AS x, arg_min(y, line_no) AS y FROM headed WHERE text = 'Abstract' GROUP BY 1",
    "outlines_with_items": f"""WITH {_OUTLINE}, items AS (SELECT doc_id, -1 - line_no::BIGINT AS node_id, CASE WHEN line_no % 5 = 1 THEN 'Figure' ELSE 'Note' END AS title, page_no - 1 AS page_index, y AS top, line_no FROM headed WHERE line_no % 5 = 1 OR line_no % 11 = 2),
      held AS (SELECT i.doc_id, i.node_id, arg_max(o.node_id, (o.page_index, -o.top, o.node_id)) FILTER (o.page_index < i.page_index OR (o.page_index = i.page_index AND o.top >= i.top)) AS parent, arg_max(o.node_id, o.ord) FILTER (o.parent_id IS NULL) AS last FROM items i LEFT JOIN outlines o ON o.doc_id = i.doc_id GROUP BY 1, 2),
      every AS (SELECT doc_id, node_id, parent_id, 'section' AS kind, title, page_index, top FROM outlines UNION ALL SELECT i.doc_id, i.node_id, coalesce(h.parent, h.last), 'item', title, page_index, top FROM items i JOIN held h ON h.doc_id = i.doc_id AND h.node_id = i.node_id),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY page_index, top DESC, kind DESC, node_id DESC)::INT AS nth FROM every)
      SELECT a.doc_id, a.node_id, a.parent_id, a.kind, a.title, a.nth, coalesce(c.nth || '.', '') || coalesce(b.nth || '.', '') || a.nth AS path FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.node_id = a.parent_id LEFT JOIN n c ON c.doc_id = b.doc_id AND c.node_id = b.parent_id""",
    "section_targets": f"""WITH {_OUTLINE}, keyed AS (SELECT *, 'section' AS kind, CASE WHEN title LIKE 'IV.%' THEN '4' WHEN title LIKE 'A Large%' THEN 'A' WHEN regexp_matches(title, '^[0-9]') THEN string_split(title, ' ')[1] WHEN title LIKE 'Appendix%' THEN 'B' END AS target FROM outlines
        UNION ALL SELECT *, 'appendix', CASE WHEN title LIKE 'A Large%' THEN 'A' WHEN title LIKE 'Appendix%' THEN 'B' END FROM outlines)
      SELECT doc_id, kind, target, arg_min(page_index + 1, ord)::INT AS page_no, arg_min(title, ord) AS text FROM keyed WHERE target IS NOT NULL GROUP BY 1, 2, 3""",
    "chosen_outlines": f"""WITH {_OUTLINE}, marks AS (SELECT * FROM outlines WHERE doc_id % 3 <> 0), r AS (SELECT doc_id, count(*) FILTER (parent_id IS NULL) AS roots, min(node_id) FILTER (parent_id IS NULL) AS root FROM marks GROUP BY 1),
      s AS (SELECT r.*, (SELECT count(*) FROM marks m WHERE m.doc_id = r.doc_id AND m.parent_id = r.root) AS below FROM r), good AS (SELECT * FROM s WHERE roots > 1 OR below > 1)
      SELECT m.doc_id, node_id, CASE WHEN roots = 1 AND parent_id = root THEN NULL ELSE parent_id END AS parent_id, title FROM marks m JOIN good g USING (doc_id) WHERE NOT (roots = 1 AND node_id = root)
      UNION ALL SELECT doc_id, node_id, parent_id, 'found: ' || title FROM outlines WHERE doc_id NOT IN (SELECT doc_id FROM good)""",
    "purged_outlines": f"""WITH {_OUTLINE} SELECT doc_id, node_id FROM outlines WHERE parent_id IS NULL OR doc_id % 2 = 1""",
    "outlines_with_abstract": f"""WITH {_OUTLINE}, o AS (SELECT * FROM outlines WHERE title <> 'Abstract' OR doc_id % 2 = 0), d AS (SELECT doc_id, bool_or(title = 'Abstract') AS has, min(ord) FILTER (parent_id IS NULL AND (page_index > 0 OR top <= 690)) AS before, max(ord) FILTER (parent_id IS NULL) AS last FROM o GROUP BY 1),
      u AS (SELECT doc_id, node_id, ord::DOUBLE AS o, title FROM o UNION ALL SELECT doc_id, -1, coalesce(before - 0.5, last + 0.5, 0), 'Abstract' FROM d WHERE NOT has)
      SELECT doc_id, node_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, node_id) - 1)::INT AS ord, title FROM u""",
    "document_title_choice": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND length(p_type[1 : p_partkey % 20]) > length(p_name) THEN p_type[1 : p_partkey % 20] ELSE p_name END AS title FROM part",
    "nearest_heading_lines": f"""WITH {_HEADED} SELECT a.doc_id, a.page_no, a.line_no AS point_no, arg_min(b.line_no, (abs(b.y - a.y + 8.5) + abs(b.x - a.x - 7), b.line_no)) AS line_no FROM headed a JOIN headed b USING (doc_id, page_no) WHERE a.line_no % 5 = 0 GROUP BY 1, 2, 3""",
    "reading_order": f"""WITH {LINES_SQL}, c AS (SELECT *, CASE WHEN line_no % 9 = 0 THEN -1 WHEN x > 300 THEN 1 ELSE 0 END AS col FROM lines), b AS (SELECT a.doc_id, a.line_no, a.page_no, a.col, a.y, count(*) FILTER (o.col = -1) AS band FROM c a JOIN c o ON a.doc_id = o.doc_id AND a.page_no = o.page_no AND o.y >= a.y GROUP BY ALL)
      SELECT doc_id, line_no AS ord, band, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no, band, col, y DESC, line_no) - 1)::INT AS place FROM b""",
    "column_of_lines": f"""WITH {LINES_SQL}, counted AS (SELECT doc_id, page_no, (floor(x / 2 + 0.5) * 2)::BIGINT AS q, count(*) AS n FROM lines WHERE length(trim(text)) > 10 AND w < 0.6 * 612 GROUP BY 1, 2, 3),
      two AS (SELECT doc_id, page_no FROM counted GROUP BY 1, 2 HAVING count(*) = 2 AND min(n) >= 3 AND max(q) - min(q) > 0.2 * 612 AND sum(n) >= 6)
      SELECT l.doc_id, line_no, CASE WHEN t.doc_id IS NULL THEN -1 WHEN x >= 198 THEN 1 ELSE 0 END::INT AS column_no FROM (SELECT DISTINCT doc_id, page_no FROM counted) k JOIN lines l USING (doc_id, page_no) LEFT JOIN two t USING (doc_id, page_no)""",
    "bounding_anchors": None,
    "entry_rects": None,
    "entry_anchors": f"""WITH {LINES_SQL} SELECT doc_id, (line_no // 3)::BIGINT AS entry, arg_min(page_no, line_no) AS page_no, arg_min(x, line_no) AS start_x, arg_min(y - h / 2, line_no) AS start_y, arg_max(x + w, line_no) AS end_x, arg_max(y - h / 2, line_no) AS end_y, trim(string_agg(text, ' ' ORDER BY line_no)) AS text,
      regexp_matches(trim(string_agg(text, ' ' ORDER BY line_no))[1:100], '(?i)(?:^|[^a-z0-9_])(?:et\\s+al|and)(?:$|[^a-z0-9_])|,.*,|&') AS has_multiple_authors FROM lines GROUP BY 1, 2""",
    "heading_regions": f"""WITH {LINES_SQL} SELECT doc_id, line_no FROM lines WHERE page_no >= CASE WHEN doc_id % 2 = 0 THEN (doc_id % 4) // 2 + 1 ELSE 1 END AND NOT (page_no <= 1 AND y > CASE WHEN doc_id % 3 = 0 THEN 700 - 42 WHEN doc_id % 2 = 0 THEN 650 ELSE 792 END)""",
    "usable_indexes": "SELECT l_orderkey AS doc_id, count(*) AS n_entries, count(*) >= 5 AS usable FROM lineitem GROUP BY 1",
    "tree_descendants": """WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
      SELECT 100000000 + s_suppkey AS ancestor, 1 AS n FROM s UNION ALL SELECT n_regionkey * 1000000 + 1000 * (n_nationkey + 1), 1 + (SELECT count(*) FROM s WHERE s.n_nationkey = nation.n_nationkey) FROM nation
      UNION ALL SELECT r_regionkey * 1000000, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM s WHERE s.n_regionkey = r_regionkey) FROM region""",
    "normalized_headings": f"""WITH {_OUTLINE} SELECT doc_id, ord AS line_no, CASE WHEN title LIKE 'Appendix%' THEN 'proofs' WHEN title LIKE 'IV%' THEN 'third part' WHEN regexp_matches(title, '^[0-9]') THEN lower(regexp_replace(title, '^[0-9.]+ ', '')) ELSE lower(title) END AS heading, CASE WHEN title LIKE 'Appendix%' THEN 'B' WHEN title LIKE 'A Large%' THEN 'A' ELSE '' END AS letter FROM outlines""",
    "line_layouts": f"""WITH {LINES_SQL}, s AS (SELECT * FROM lines WHERE length(trim(text)) > 10), m AS (SELECT doc_id, count(*) AS n, list_sort(list(w))[greatest(ceil(0.9 * count(*)), 1)::INT] AS wide, median(h) AS height FROM s GROUP BY 1),
      q AS (SELECT doc_id, arg_min(q, (-n, f)) AS left_x FROM (SELECT doc_id, floor(x / 2 + 0.5) * 2 AS q, count(*) AS n, min(line_no) AS f FROM s GROUP BY 1, 2) GROUP BY 1),
      t AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (w >= 0.5 * wide) AS measured, count(*) FILTER (w >= 0.5 * wide AND abs(w - wide) < 3 * height) AS fl, count(*) FILTER (x > left_x + height) AS inset FROM s JOIN m USING (doc_id) JOIN q USING (doc_id) GROUP BY 1)
      SELECT d.doc_id, coalesce(n >= 5 AND fl >= 0.7 * measured, false) AS straight, coalesce(n >= 5 AND inset >= 3 AND inset >= 0.1 * n, false) AS indents FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN t USING (doc_id)""",
}
from foliograph.plans.places import _RECTS  # noqa: E402

ORACLES["bounding_anchors"] = f"""{_RECTS}, p AS (SELECT * FROM rects WHERE no % 2 = 0), a AS (SELECT * FROM rects WHERE no % 2 = 1),
  near AS (SELECT p.doc_id, p.page_no, p.no AS point_no, arg_min(a.no, (abs(a.x - p.x) + abs(a.y - p.y), a.no)) AS cur FROM p JOIN a ON a.doc_id = p.doc_id AND a.page_no = p.page_no GROUP BY 1, 2, 3),
  reach AS (SELECT doc_id, (page_no + 1) % 3 AS page_no, min(no) AS cur FROM a GROUP BY 1, 2),
  c AS (SELECT p.doc_id, p.page_no, p.no AS point_no, coalesce(n.cur, r.cur) AS cur FROM p LEFT JOIN near n ON n.doc_id = p.doc_id AND n.point_no = p.no LEFT JOIN reach r ON r.doc_id = p.doc_id AND r.page_no = p.page_no)
  SELECT c.doc_id, c.page_no, point_no, cur AS current, min(a.no) AS next FROM c LEFT JOIN a ON a.doc_id = c.doc_id AND a.no > c.cur GROUP BY 1, 2, 3, 4"""
ORACLES["entry_rects"] = f"""{_RECTS} SELECT doc_id, no // 3 AS ref_ord, page_no, count(*) AS n, arg_min(x, no) AS first_x, arg_max(y, no) AS last_y FROM rects GROUP BY 1, 2, 3"""
ORACLES["distinct_figures"] = f"""{_RECTS} SELECT doc_id, min(no) AS ord FROM rects GROUP BY doc_id, no % 2, floor(y / 21 + 0.5)"""


def _plain(text: str) -> str:
    """SQL for a normalised heading."""
    number = r"^(?:[0-9]+(?:\.[0-9]+)*\.?\s+|\([0-9]+\)\s*|[A-Z]\.(?:[0-9]+(?:\.[0-9]+)*\.?)?\s+|\([A-Za-z]\)\s*|[IVXLCDM]+\.\s+|\([IVXLCDM]+\)\s*)"
    return rf"regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(trim({text}), '{number}', ''), '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')), '^appendix\s*(?:[a-z]\s+)?', '')"


# every bookmark with every line of its document by the rule, then one bookmark after the other with the line reached as a state
ORACLES["located_bookmarks"] = rf"""WITH RECURSIVE {_HEADED}, {_METRICS},
  marks AS (SELECT doc_id, line_no::BIGINT AS node_id, CASE WHEN line_no % 7 = 3 AND NOT contains(text, 'lower') THEN text WHEN line_no % 7 = 5 THEN regexp_replace(text, ' [^ ]*$', '') WHEN line_no % 7 = 1 THEN array_to_string(string_split(text, ' ')[1:6], ' ') END AS title FROM headed),
  asked AS MATERIALIZED (SELECT *, {_plain("title")} AS key, CASE WHEN regexp_matches(title, '(?i)^\s*appendix\s+[A-Z](?:[^A-Za-z0-9_]|$)') THEN upper(regexp_extract(title, '(?i)^\s*appendix\s+([A-Z])', 1)) ELSE regexp_extract(title, '^\s*([A-Z])(?:\.|\s)', 1) END AS letter, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS nth FROM marks WHERE title IS NOT NULL),
  read AS MATERIALIZED (SELECT h.doc_id, line_no, lower(trim(text)) AS low, {_plain("text")} AS line, h.h > 1.2 * m.line_height OR line_no % 11 = 1 OR h.style IN (1, 3) AS shown FROM headed h JOIN metrics m USING (doc_id)),
  split AS (SELECT a.doc_id, a.nth, a.key, a.letter, r.line_no, r.low, r.line, r.shown, string_split(a.key, ' ') AS ws, string_split(r.line, ' ') AS os FROM asked a JOIN read r USING (doc_id)),
  found AS MATERIALIZED (SELECT doc_id, nth, list(line_no ORDER BY line_no) AS at FROM split WHERE (letter <> '' AND (starts_with(low, lower(letter) || '. ') OR regexp_extract(low, '(?:^|[^a-z0-9_])appendix\s+([a-z])(?:[^a-z0-9_]|$)', 1) = lower(letter))) OR (key <> '' AND key = line)
      OR (length(key) > 25 AND len(ws) >= 3 AND len(os) >= 2 AND len(list_filter(ws, lambda w: list_contains(os, w))) / greatest(len(ws), len(os)) >= CASE WHEN shown THEN 0.4 ELSE 0.85 END) GROUP BY 1, 2),
  st AS (SELECT DISTINCT doc_id, 0::BIGINT AS nth, 0 AS here, NULL::BIGINT AS node_id, NULL::INT AS line_no FROM asked
    UNION ALL SELECT doc_id, nth, coalesce(hit, here), CASE WHEN hit IS NOT NULL THEN node_id END, hit FROM (
      SELECT a.doc_id, a.nth, a.node_id, st.here, list_min(list_filter(coalesce(f.at, []), lambda l: l >= st.here)) AS hit FROM st JOIN asked a ON a.doc_id = st.doc_id AND a.nth = st.nth + 1 LEFT JOIN found f ON f.doc_id = a.doc_id AND f.nth = a.nth))
  SELECT doc_id, node_id, line_no FROM st WHERE node_id IS NOT NULL"""


def _margins(of: str) -> str:
    """SQL for the left margin of each page of lines ``of``, and those of them that can belong to a reference section."""
    mode = "SELECT doc_id, page_no, arg_min(q, (-n, f)) AS m FROM (SELECT doc_id, page_no, floor(x * 2 + 0.5) / 2 AS q, count(*) AS n, min(line_no) AS f FROM {t} GROUP BY 1, 2, 3) GROUP BY 1, 2"
    return f"""long_lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS nth FROM {of} WHERE length(text) > 10) WHERE nth <= 10 AND w <= 0.9 * 612),
  margins AS (SELECT e.doc_id, e.page_no, coalesce(s.m, e.m) AS margin FROM ({mode.format(t=of)}) e LEFT JOIN ({mode.format(t="long_lines")}) s USING (doc_id, page_no)),
  eligible AS MATERIALIZED (SELECT l.*, margin, x <= margin + 20 AS edge FROM {of} l JOIN margins USING (doc_id, page_no) WHERE length(trim(text)) > 3 AND y < 792 AND y > 0 AND NOT (x + w <= margin OR x >= 612 - margin) AND NOT (length(trim(text)) < 10 AND regexp_extract(lower(trim(text)), 'page\\s+([0-9]+)', 1) = page_no::VARCHAR))"""


# the numbers that lines begin with, from a document's end backwards, with the run and its length as a state
_PROBED = r"""tail AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) - 1 AS place FROM eligible e JOIN (SELECT doc_id, max(page_no) AS pages FROM eligible_of GROUP BY 1) USING (doc_id) WHERE page_no >= ceil(pages * 0.6) AND y < 0.97 * 792 AND y > 0.03 * 792),
  told AS (SELECT doc_id, place, line_no, k, regexp_extract(text, p, 1) AS n, row_number() OVER (PARTITION BY doc_id, k ORDER BY place) AS nth FROM tail, (VALUES (0, '^\s*\[([0-9]{0,3})\]'), (1, '^\s*\(([0-9]{0,3})\)'), (2, '^\s*([0-9]{1,3})\.\s')) t(k, p) WHERE regexp_matches(text, p)),
  seq AS MATERIALIZED (SELECT doc_id, k, nth, place, line_no, try_cast(n AS INT) AS n FROM told),
  probe AS (SELECT doc_id, k, nth, place, line_no, n, 1 AS run, 0.0::DOUBLE AS way, 0 AS steps, false AS found, false AS over FROM seq WHERE nth = 1
    UNION ALL SELECT doc_id, k, nth, place, line_no, n, CASE WHEN found THEN run WHEN follows THEN now + 1 ELSE 1 END, CASE WHEN found THEN way WHEN follows THEN length + place - before ELSE length END, CASE WHEN found THEN steps WHEN follows THEN taken + 1 ELSE taken END,
        found OR (follows AND now + 1 >= 3), over OR (found AND place - before - 1 > ceil(2.5 * way / steps)) FROM (
      SELECT *, now > 0 AND n = last_n - 1 AS follows FROM (
        SELECT s.doc_id, s.k, s.nth, s.place, s.line_no, s.n, p.place AS before, p.n AS last_n, p.run, p.way, p.steps, p.found, p.over, CASE WHEN quiet THEN 0 ELSE p.run END AS now, CASE WHEN quiet THEN 0 ELSE p.way END AS length, CASE WHEN quiet THEN 0 ELSE p.steps END AS taken
        FROM probe p JOIN seq s ON s.doc_id = p.doc_id AND s.k = p.k AND s.nth = p.nth + 1, LATERAL (SELECT s.place - p.place - 1 > CASE WHEN p.steps > 0 THEN 3 * p.way / p.steps ELSE 10 END AS quiet)))),
  probed AS (SELECT doc_id, arg_min(start_line, k) AS start_line FROM (SELECT doc_id, k, greatest(min(line_no) - 1, 0)::INT AS start_line FROM probe WHERE found AND NOT over GROUP BY 1, 2) GROUP BY 1)"""


def _numbered(of: str, which: str) -> str:
    return f"SELECT doc_id, line_no, page_no, CASE WHEN {which} AND (last - line_no) % 3 = 2 AND last - line_no < 15 THEN '[' || (5 - (last - line_no) // 3) || '] ' || text ELSE text END AS text, x, y, w, h, style FROM {of} JOIN (SELECT doc_id, max(line_no) AS last FROM {of} GROUP BY 1) USING (doc_id)"


ORACLES["probed_sections"] = f"""WITH RECURSIVE {LINES_SQL}, eligible_of AS MATERIALIZED ({_numbered("lines", "true")}), {_margins("eligible_of")}, {_PROBED} SELECT doc_id, start_line FROM probed"""
_HEADS = ", ".join(f"'{x}'" for x in ("references", "bibliography"))
_LATER = ", ".join(f"'{x}'" for x in references.LATER_HEADINGS)
ORACLES["reference_sections"] = f"""WITH RECURSIVE {_OUTLINE}, {_METRICS},
  kept AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 1 AND text = 'References' THEN 'Remarks' ELSE text END AS text) FROM headed),
  eligible_of AS MATERIALIZED ({_numbered("kept", "doc_id % 3 = 1")}), {_margins("eligible_of")}, {_PROBED},
  first AS (SELECT doc_id, arg_min(page_index + 1, ord) AS page_no, arg_min("left", ord) AS px, arg_min(top, ord) AS py FROM outlines WHERE doc_id % 6 = 0 AND page_index >= 3 AND lower(trim(title)) IN ({_HEADS}) GROUP BY 1),
  starts AS (SELECT l.doc_id, 1 AS tier, arg_min(line_no, (abs(y - py) + abs(x - px), line_no)) AS start_line FROM eligible_of l JOIN first f ON f.doc_id = l.doc_id AND f.page_no = l.page_no GROUP BY 1
    UNION ALL SELECT doc_id, 2, min(line_no) FROM eligible_of WHERE page_no >= 3 AND y < 0.95 * 792 AND y > 0.05 * 792 AND lower(trim(text)) IN ({_HEADS}) GROUP BY 1
    UNION ALL SELECT doc_id, 3, start_line FROM probed),
  bottoms_of AS (SELECT doc_id, page_no, min(y) AS bottom, max(line_no) AS page_end FROM eligible_of GROUP BY 1, 2),
  after AS (SELECT s.tier, s.start_line, e.*, bool_or(edge) OVER (PARTITION BY e.doc_id, s.tier, e.page_no ORDER BY line_no) AS counts, m.line_height AS body, m.margin_bottom AS low, bottom, page_end FROM eligible e JOIN starts s ON s.doc_id = e.doc_id AND e.line_no > s.start_line JOIN metrics m ON m.doc_id = e.doc_id JOIN bottoms_of b ON b.doc_id = e.doc_id AND b.page_no = e.page_no),
  counted AS (SELECT *, min(CASE WHEN replace(regexp_replace(lower(trim(text)), '^(?:[0-9]+(?:\\.[0-9]+)*\\.?|[ivxlcdm]+\\.)\\s+', ''), ' ', '') IN ({_LATER}) OR (h > 1.5 * body AND style = 1) OR (y = bottom AND line_no = page_end AND bottom > low + 0.4 * 792) THEN line_no END) OVER (PARTITION BY doc_id, tier) AS stop FROM after WHERE counts),
  ended AS (SELECT doc_id, tier, max(line_no) AS last, any_value(stop) AS stop, count(*) AS n FROM counted WHERE stop IS NULL OR line_no < stop GROUP BY 1, 2),
  every AS (SELECT s.doc_id, s.tier, s.start_line, coalesce(stop - 1, last, s.start_line + 1)::INT AS end_line, coalesce(n, 0) AS n FROM starts s LEFT JOIN ended e ON e.doc_id = s.doc_id AND e.tier = s.tier)
  SELECT doc_id, arg_min(start_line, tier)::INT AS start_line, arg_min(end_line, tier) AS end_line, min(tier)::INT AS tier FROM every WHERE tier = 2 OR n >= 3 GROUP BY 1"""
