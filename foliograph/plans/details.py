"""Queries over stored state, targets, groups and what is shown, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.folds import cut, shared_folder
from foliograph.operators import annotations as A
from foliograph.operators import details as D
from foliograph.operators import layout, markup, store, trees
from foliograph.plans.layout import METRICS_SQL
from foliograph.plans.places import _RECTS, _rects, _tree
from foliograph.sources.adapters import LINES_SQL, REFERENCES_SQL, lines, references, table
from foliograph.streaming.store import KeyedTable


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value", "event_id")
    return store.current(changes, ["user_id"]).select("user_id", "event_id", "value")


def annotation_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("color"), F.col("p_name").alias("comment"), F.lit(0).cast("long").alias("updated_at"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).alias("color"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("comment"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("updated_at"), F.when(F.col("l_quantity") == 50, F.array(F.lit("comment"))).alias("cleared"))
    return store.updated(rows, changes, "id", ["color", "comment"])


def load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "p").alias("pending"), F.when(k % 3 == 0, "f").alias("fetched"), F.when(k % 5 > 0, "d").alias("direct"))
    return store.first_source(rows, "p_partkey", ["pending", "fetched", "direct"])


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", store.setting(value, "string").alias("value"))


def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).select("doc_id", "ref_ord", "ref_index", (F.col("ref_ord") % 5).alias("page_no"), (F.col("ref_ord") * 2.0).alias("x"), (F.col("ref_ord") * 3.0).alias("y"))
    cited = refs.groupBy("doc_id").agg(F.array(F.max("ref_index").cast("string"), F.lit("1"), F.lit("77")).alias("refs")).withColumn("cit_no", F.lit(1))
    parts = refs.select("doc_id", F.lit(1).alias("cit_no"), F.col("ref_ord").alias("part_no"), F.col("ref_index").cast("string").alias("ref_index"), F.col("x").alias("rect")).where("ref_ord % 2 = 1")
    return D.targets(cited, refs, D.distinct_parts(parts))


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.totals(_rects(spark, sf_dir))


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_page(_rects(spark, sf_dir), "no").select("doc_id", "page_no", "n", F.array_join(F.transform("rows", lambda r: r["no"].cast("string")), ",").alias("nos"))


def shown_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    thin = F.struct("rect.x", "rect.y", (F.col("rect.w") - 45).alias("w"), "rect.h")
    return rows.select("doc_id", "no", D.inside_page(thin, F.lit(500.0), F.lit(140.0)).alias("inside"), D.drawable(thin, F.col("no") % 3 == 0).alias("drawn"), D.renderable(F.when(F.col("no") % 4 > 0, "text").otherwise(" "), F.col("rect.w"), F.col("rect.h"), F.lit(0.9)).alias("rendered"))


def focus_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    total = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(total, "doc_id").select("doc_id", "no", D.focused(F.col("no") - 1, F.lit(1), F.col("n")).alias("next"), D.focused(F.col("no") - 1, F.lit(-1), F.col("n")).alias("previous"))


def pages_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    pages = rows.select("doc_id", F.col("no").alias("page_no"), ((F.col("no") - 1) * 100.0).alias("top"), F.lit(95.0).alias("height"))
    views = rows.select("doc_id", F.col("no").alias("view_no"), (F.col("rect.x") * 1.0).alias("top"), F.lit(60.0).alias("height"))
    return D.current_pages(pages, views)


def scroll_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = D.scroll_progress(F.col("l_extendedprice"), F.lit(100.0), F.col("l_quantity") * 2000)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.max(share), 6).alias("most"), F.round(F.min(share), 6).alias("least"), F.count_if(D.complete(share)).alias("complete"))


def subtree_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    marks = table(spark, sf_dir, "supplier").select((100000000 + F.col("s_suppkey")).alias("section_id"), F.col("s_suppkey").alias("mark_id"), (F.col("s_suppkey") % 7).cast("string").alias("color"))
    return A.subtree_dots(marks, trees.subtree_pairs(tree))


def color_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("Black", "yellow", "RED", "blue", "green", "pink")))
    return table(spark, sf_dir, "part").select("p_partkey", markup.color_code(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("code"))


def rect_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = A.ratios(F.col("rect"), F.lit(612.0), F.lit(792.0))
    back = A.absolute(ratio, F.lit(612.0), F.lit(792.0))
    return _rects(spark, sf_dir).select("doc_id", "no", F.round(ratio["left_ratio"], 9).alias("left_ratio"), F.round(ratio["height_ratio"], 9).alias("height_ratio"), F.round(back["y"], 6).alias("y"), F.round(back["w"], 6).alias("w"))


def stroke_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    turn = A.rotation(F.lit(10.0), at(F.lit(0.0), F.lit(0.0)), at(F.lit(1.0), F.lit(0.0)), at(F.col("rect.x") + 1, F.col("rect.y")))
    return _rects(spark, sf_dir).select("doc_id", "no", F.round(turn, 6).alias("rotation"), F.round(A.resized(F.col("rect.w"), F.col("rect.y") - 60), 6).alias("factor"))


def comment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles as marks and comments in turn; every third comment names the mark before it, others choose."""
    rows = _rects(spark, sf_dir).select("doc_id", "page_no", "no", "rect.x", "rect.y")
    marks = rows.where("no % 2 = 0").withColumnRenamed("no", "mark_id")
    comments = rows.where("no % 2 = 1").withColumn("linked", F.when(F.col("no") % 3 == 0, F.col("no") - 1)).withColumnRenamed("no", "comment_id")
    return A.commented(marks, comments, 612.0, 792.0)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a search result, the numbers of papers and citation formats in front, each in several ways by its key."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    result = F.concat(F.lit('<div class="gs_r"><div class="gs_ri"><h3 class="gs_rt"><a href="https://h/'), n, F.lit('">On <b>page</b> '), n, F.lit(' &amp; more</a></h3><div class="gs_fmaa"><a>A. '), n, F.lit('</a>, <a> B. Two </a></div><div class="gsh_csp">short</div><div class="gs_fma_snp">'), F.when(k % 2 == 0, "a longer one").otherwise("no"), F.lit("</div></div></div>"))
    paper = F.when(k % 4 == 0, F.concat(F.lit('<div data-cid="C'), n, F.lit('x"></div><a href="?cites=1">'))).when(k % 4 == 1, F.concat(F.lit('<a href="/s?hl=en&amp;cites='), n, F.lit('&amp;x=1">'))).when(k % 4 == 2, F.concat(F.lit('<button data-clk-atid="B'), n, F.lit('">'))).otherwise("")
    formats = F.concat(F.lit('<table><tr><th class="gs_cith">MLA</th><td><div class="gs_citr">Q. <i>'), n, F.lit('</i></div></td></tr><tr><th scope="row" class="x gs_cith"> APA </th><td><div tabindex="0" class="gs_citr">R.</div></td></tr></table><div id="gs_citi"><a href="'), F.when(k % 3 == 0, "https://h").otherwise(""), F.lit("/scholar.bib?q="), n, F.lit('&amp;y">BibTeX</a></div>'))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(k % 5 > 0, result).otherwise(""), paper, F.when(k % 7 > 0, formats).otherwise(""), "html").alias("html"))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _results(spark, sf_dir).select("page_id", markup.search_result(F.col("html")).alias("r"))
    return read.select("page_id", "r.title", "r.link", F.array_join("r.authors", "; ").alias("authors"), "r.abstract")


def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("page_id", markup.paper_id(F.col("html")).alias("paper"))


def citation_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select("page_id", markup.bibliography_link(F.col("html"), "https://b").alias("bibtex"), F.explode_outer(markup.citation_formats(F.col("html"))).alias("f"))
    return rows.select("page_id", "bibtex", "f.format", "f.citation")


def exported_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks written as lines of JSON to a new folder beside the session's checkpoints, and read back."""
    rows = _rects(spark, sf_dir).where("no % 5 = 0").select("doc_id", "page_no", F.col("no").alias("mark_id"), "rect", F.when(F.col("no") % 2 == 0, "seen").alias("comment"))
    folder = f"{shared_folder(spark)}/exported-{uuid.uuid4().hex}"
    store.exported(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select("doc_id", "page_no", "mark_id", "rect.x", "rect.w", "comment")


def citation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every third line's citation stands for: an entry by its index or year, what stands at a place, or no valid place."""
    rows = cut(lines(spark, sf_dir))  # read by every branch
    k = F.col("line_no")
    refs = rows.where("line_no % 5 = 0").select("doc_id", k.alias("ref_ord"), (k / 5).cast("int").alias("ref_index"), "text", (2000 + k % 10).cast("string").alias("year"))
    cited = rows.where("line_no % 3 = 0").select("doc_id", k.cast("long").alias("cit_no"), F.when(k % 4 == 0, (k / 5).cast("int").cast("string")).alias("ref_index"), F.when(k % 4 == 1, "qqqq").alias("author"), F.when(k % 4 == 1, (2000 + k % 10).cast("string")).alias("year"), "page_no", (F.col("x") + 3).alias("x"), F.when(k % 4 == 3, 0.0).otherwise(F.col("y") - 2).alias("y"))
    return D.citation_texts(cited, refs, rows, layout.body_metrics(rows), layout.columns(rows))


def _filled(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """A new keyed table of the session's shared folder, after all events in three batches by time, each given twice: errors delete a reader's
    row, views take it, all others put it."""
    kept = KeyedTable(spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", "user_id long, value double", ["user_id"], 16)
    kind = F.col("event_type")
    changes = table(spark, sf_dir, "events").select("user_id", "value", F.when(kind == "error", "delete").when(kind == "view", "take").otherwise("put").alias("op"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    for batch, (first, last) in enumerate((("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01"))):
        part = changes.where((F.col("at") >= F.lit(first).cast("timestamp")) & (F.col("at") < F.lit(last).cast("timestamp")))
        kept.apply(part, "events", batch)
        kept.apply(part, "events", batch)
    return kept


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).rows()


def stored_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).taken()


QUERIES = {f.__name__: f for f in (stored_state, annotation_updates, load_sources, stored_settings, citation_targets, page_totals, page_groups, shown_rects, focus_moves, pages_in_view, scroll_progress, subtree_dots, color_codes, rect_ratios, stroke_turns, comment_marks, search_results, paper_ids, citation_formats, exported_annotations, citation_texts, stored_table, stored_takes)}
ORACLES = {
    "stored_table": "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type NOT IN ('error', 'view')",
    "stored_takes": "SELECT event_id, user_id, held AS value FROM (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS held FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND before NOT IN ('error', 'view')",
    # a page's comments in order, each to the nearest mark that no earlier one has
    "comment_marks": f"""{_RECTS.replace("WITH ", "WITH RECURSIVE ", 1)}, named AS (SELECT c.doc_id, c.no AS comment_id, c.no - 1 AS mark_id FROM rects c WHERE c.no % 6 = 3),
      asking AS (SELECT doc_id, page_no, no, x, y, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY no) AS nth FROM rects WHERE no % 2 = 1 AND no % 3 > 0),
      free AS (SELECT doc_id, page_no, list({{'no': no, 'x': x, 'y': y}} ORDER BY no) AS marks FROM rects m WHERE no % 2 = 0 AND NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = m.doc_id AND n.mark_id = m.no) GROUP BY 1, 2),
      st AS (SELECT doc_id, page_no, 0::BIGINT AS nth, marks AS remaining, NULL::BIGINT AS comment_id, NULL::BIGINT AS mark_id FROM free
        UNION ALL SELECT doc_id, page_no, nth, CASE WHEN hit IS NULL THEN remaining ELSE list_filter(remaining, lambda m: m.no <> hit) END, CASE WHEN hit IS NOT NULL THEN no END, hit FROM (
          SELECT a.*, st.remaining, list_min(list_transform(list_filter(st.remaining, lambda m: (m.x - a.x) ** 2 + (m.y - a.y) ** 2 < 79.2 ** 2), lambda m: {{'off': (m.x - a.x) ** 2 + (m.y - a.y) ** 2, 'no': m.no}})).no AS hit FROM st JOIN asking a ON a.doc_id = st.doc_id AND a.page_no = st.page_no AND a.nth = st.nth + 1))
      SELECT doc_id, comment_id, mark_id FROM st WHERE comment_id IS NOT NULL UNION ALL SELECT * FROM named""",
    "search_results": """SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'On page ' || page_id || ' & more' END AS title, CASE WHEN page_id % 5 > 0 THEN 'https://h/' || page_id END AS link, CASE WHEN page_id % 5 > 0 THEN 'A. ' || page_id || '; B. Two' END AS authors, CASE WHEN page_id % 5 > 0 THEN CASE WHEN page_id % 2 = 0 THEN 'a longer one' ELSE 'short' END END AS abstract FROM pages""",
    "paper_ids": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C' || page_id || 'x' WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN 'B' || page_id END AS paper FROM pages",
    "citation_formats": """SELECT page_id, CASE WHEN page_id % 7 > 0 THEN CASE WHEN page_id % 3 = 0 THEN 'https://h' ELSE 'https://b' END || '/scholar.bib?q=' || page_id || '&y' END AS bibtex, f AS format, CASE WHEN f = 'MLA' THEN 'Q. ' || page_id WHEN f = 'APA' THEN 'R.' END AS citation
      FROM (SELECT page_id, unnest(CASE WHEN page_id % 7 > 0 THEN ['MLA', 'APA'] ELSE [NULL] END) AS f FROM pages)""",
    "exported_annotations": f"{_RECTS} SELECT doc_id, page_no, no AS mark_id, x, w, CASE WHEN no % 2 = 0 THEN 'seen' END AS comment FROM rects WHERE no % 5 = 0",
    # a place's lines one after the other, until one breaks off
    "citation_texts": f"""WITH RECURSIVE {LINES_SQL}, {METRICS_SQL}, seen AS (SELECT l.*, m.line_width AS wide, row_number() OVER (PARTITION BY l.doc_id, page_no ORDER BY line_no) AS k, lead(y) OVER p AS next_y, lead(text) OVER p AS next_text FROM lines l JOIN metrics m USING (doc_id) WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
      told AS MATERIALIZED (SELECT *, regexp_matches(text || CASE WHEN abs(next_y - y) < 3 THEN next_text ELSE '' END, '^\\s*[\\[(]?[0-9]{{1,3}}[\\]).,]?\\s+\\S') AS numbered FROM seen),
      st AS (SELECT doc_id, line_no AS cit_no, page_no, k, 1 AS pieces, text, x AS first_x, NULL::DOUBLE AS second_x, NULL::DOUBLE AS gap, y, w FROM told WHERE line_no % 12 IN (6, 9)
        UNION ALL SELECT t.doc_id, st.cit_no, st.page_no, t.k, st.pieces + 1, st.text || t.text, st.first_x, coalesce(st.second_x, CASE WHEN abs(t.y - st.y) > 3 THEN t.x END), coalesce(st.gap, CASE WHEN abs(t.y - st.y) > 3 THEN abs(t.y - st.y) END), t.y, t.w FROM st JOIN told t ON t.doc_id = st.doc_id AND t.page_no = st.page_no AND t.k = st.k + 1
          WHERE st.pieces <= 35 AND (abs(t.y - st.y) <= 3 OR NOT (t.numbered OR (t.wide > 0 AND st.w > 0 AND st.w < t.wide - 2 * t.h) OR (st.gap IS NOT NULL AND (abs(t.y - st.y) > 1.5 * st.gap OR t.x < CASE WHEN st.second_x > st.first_x + 6 THEN st.second_x ELSE least(st.first_x, st.second_x) END - 10))))),
      read AS (SELECT doc_id, cit_no, trim(arg_max(text, pieces)) AS text FROM st GROUP BY 1, 2),
      c AS (SELECT doc_id, line_no AS n FROM lines WHERE line_no % 3 = 0)
      SELECT c.doc_id, n::BIGINT AS cit_no, CASE n % 4 WHEN 0 THEN (SELECT text FROM lines l WHERE l.doc_id = c.doc_id AND l.line_no = n // 5 * 5) WHEN 1 THEN coalesce((SELECT arg_min(text, line_no) FROM lines l WHERE l.doc_id = c.doc_id AND l.line_no % 5 = 0 AND l.line_no % 10 = n % 10), r.text) WHEN 3 THEN 'invalid location' ELSE r.text END AS text FROM c LEFT JOIN read r ON r.doc_id = c.doc_id AND r.cit_no = n""",
    "stored_state": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS nth FROM events) WHERE nth = 1 AND event_type <> 'error'",
    "annotation_updates": """WITH u AS (SELECT l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_suppkey END AS color, CASE WHEN l_linenumber % 3 = 0 THEN 'n' || l_suppkey END AS comment, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey AS t, l_quantity = 50 AS gone FROM lineitem),
      g AS (SELECT id, arg_max(color, (t, color)) FILTER (color IS NOT NULL) AS color, arg_max(comment, (t, comment)) FILTER (comment IS NOT NULL) AS comment, max(t) AS t, bool_or(gone) AS gone FROM u GROUP BY 1)
      SELECT p_partkey AS id, coalesce(g.color, p_brand) AS color, CASE WHEN gone THEN NULL ELSE coalesce(g.comment, p_name) END AS comment, coalesce(t, 0) AS updated_at FROM part LEFT JOIN g ON p_partkey = id""",
    "load_sources": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'pending' WHEN p_partkey % 3 = 0 THEN 'fetched' WHEN p_partkey % 5 > 0 THEN 'direct' END AS source, CASE WHEN p_partkey % 2 = 0 THEN 'p' WHEN p_partkey % 3 = 0 THEN 'f' WHEN p_partkey % 5 > 0 THEN 'd' END AS value FROM part",
    "stored_settings": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE p_size::VARCHAR END AS value FROM part",
    "citation_targets": f"""WITH {REFERENCES_SQL}, c AS (SELECT doc_id, [max(ref_index)::VARCHAR, '1', '77'] AS r FROM refs GROUP BY 1), k AS (SELECT doc_id, unnest([0, 1, 2]) AS place, unnest(r) AS ref_index FROM c),
      e AS (SELECT doc_id, ref_index::VARCHAR AS ref_index, min(ref_ord) AS o, min(ref_ord) FILTER (ref_ord % 2 = 1) AS p FROM refs GROUP BY 1, 2)
      SELECT doc_id, 1 AS cit_no, place, ref_index, (o % 5)::INT AS page_no, (o * 2.0)::DOUBLE AS x, (o * 3.0)::DOUBLE AS y, (p * 2.0)::DOUBLE AS rect FROM k LEFT JOIN e USING (doc_id, ref_index)""",
    "page_totals": f"{_RECTS} SELECT doc_id, count(*) AS total, count(DISTINCT page_no) AS pages FROM rects GROUP BY 1",
    "page_groups": f"{_RECTS} SELECT doc_id, page_no, count(*) AS n, string_agg(no, ',' ORDER BY no) AS nos FROM rects GROUP BY 1, 2",
    "shown_rects": f"""{_RECTS} SELECT doc_id, no, w - 45 > 0 AND y >= 0.07 * 140 AND y <= 0.92 * 140 AND x >= 0.06 * 500 AS inside, no % 3 <> 0 AND w - 45 >= 1 AS drawn, no % 4 > 0 AS rendered FROM rects""",
    "focus_moves": f"{_RECTS}, t AS (SELECT doc_id, count(*) AS n FROM rects GROUP BY 1) SELECT doc_id, no, no % n AS next, (no - 2 + n) % n AS previous FROM rects JOIN t USING (doc_id)",
    "pages_in_view": f"{_RECTS} SELECT a.doc_id, a.no AS view_no, min(b.no) AS page_no FROM rects a JOIN rects b USING (doc_id) WHERE a.x + 30 BETWEEN (b.no - 1) * 100 AND (b.no - 1) * 100 + 95 GROUP BY 1, 2",
    "scroll_progress": "WITH s AS (SELECT l_suppkey, CASE WHEN l_quantity * 2000 > 100 THEN least(greatest(l_extendedprice / (l_quantity * 2000 - 100), 0), 1) ELSE 0 END AS s FROM lineitem) SELECT l_suppkey, round(max(s), 6) AS most, round(min(s), 6) AS least, count(*) FILTER (s >= 0.99) AS complete FROM s GROUP BY 1",
    "subtree_dots": """WITH b AS (SELECT s_suppkey, unnest([100000000 + s_suppkey, n_regionkey * 1000000 + 1000 * (n_nationkey + 1), n_regionkey * 1000000]) AS section_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      c AS (SELECT section_id, (s_suppkey % 7)::VARCHAR AS color, min(s_suppkey) AS f, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY f) AS nth FROM c)
      SELECT section_id, string_agg(color, ',' ORDER BY f) FILTER (nth <= 3) AS colors, greatest(sum(n) - 3, 0)::BIGINT AS extra FROM r GROUP BY 1""",
    "color_codes": "SELECT p_partkey, ['#000000', '#FFB300', '#E53935', '#1E88E5', '#43A047', '#FFB300'][p_partkey % 6 + 1] AS code FROM part",
    "rect_ratios": f"{_RECTS} SELECT doc_id, no, round(x / 612, 9) AS left_ratio, round(h / 792, 9) AS height_ratio, round(y, 6) AS y, round(w, 6) AS w FROM rects",
    "stroke_turns": f"{_RECTS} SELECT doc_id, no, round(10 + degrees(atan2(y, x + 1)), 6) AS rotation, round(greatest(20, w + y - 60) / w, 6) AS factor FROM rects",
}
