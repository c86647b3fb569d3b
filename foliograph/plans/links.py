"""Queries over a document's own links and what they lead to, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.folds import cut
from foliograph.operators import links as L
from foliograph.plans.places import _RECTS, _rects


def _links(spark: SparkSession, sf_dir: str, rects: DataFrame | None = None) -> DataFrame:
    """Every other rectangle of a paper as a link: to a place of the paper, or out of it."""
    rows = (_rects(spark, sf_dir) if rects is None else rects).where("no % 2 = 0")
    out = F.col("no") % 6 == 0
    return rows.select("doc_id", "page_no", F.col("no").alias("link_no"), F.when(out, "action").otherwise("destination").alias("kind"), F.when(~out, F.col("no") % 3).alias("dest_page"), F.when(~out, F.col("rect.x") * (F.col("no") % 4 - 1).cast("double") % 400).alias("dest_x"), F.when(~out, F.col("rect.y") + (F.col("no") % 5) * 9 - 9).alias("dest_y"), F.when(out & (F.col("no") % 12 == 0), F.concat(F.lit("https://h/"), F.col("no").cast("string"))).alias("uri"), "rect")


def _anchors(spark: SparkSession, sf_dir: str, rects: DataFrame | None = None) -> DataFrame:
    return (_rects(spark, sf_dir) if rects is None else rects).where("no % 2 = 1").select("doc_id", F.col("no").alias("ref_ord"), F.col("no").cast("string").alias("ref_index"), (F.col("page_no") + 1).alias("page_no"), "rect.x", "rect.y")


def _sections(spark: SparkSession, sf_dir: str, rects: DataFrame | None = None) -> DataFrame:
    return (_rects(spark, sf_dir) if rects is None else rects).select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).alias("start_page"), F.lit(2).alias("end_page"))


def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.citation_links(_links(spark, sf_dir), _anchors(spark, sf_dir), _sections(spark, sf_dir))
    return found.select("doc_id", "page_no", "link_no", "valid", "ref_index")


def merged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = cut(_rects(spark, sf_dir))  # numbered once for citations, links, anchors and sections
    kinds = F.get(F.array(*(F.lit(k) for k in ("numeric", "author-year", "abbreviated"))), (F.col("no") % 3).cast("int"))
    found = rects.where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("cit_no"), kinds.alias("type"), F.array("rect").alias("rects"), F.array(F.col("no").cast("string"), (F.col("no") + 2).cast("string")).alias("refs"), "confidence", F.lit(0).alias("flags"))
    every = L.citation_links(_links(spark, sf_dir, rects), _anchors(spark, sf_dir, rects), _sections(spark, sf_dir, rects))
    return L.merged_citations(found, every).select("doc_id", "page_no", "place", "type", F.array_join("refs", ",", "null").alias("refs"), F.round("confidence", 6).alias("confidence"), "flags", "dest_page")


def merged_crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.get(F.array(F.lit("figure"), F.lit("table")), (F.col("no") % 4 / 2).cast("int"))
    found = _rects(spark, sf_dir).where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("ord"), kinds.alias("kind"), F.col("no").cast("string").alias("target"), "rect")
    targets = _rects(spark, sf_dir).where("no % 3 = 0").select("doc_id", F.lit("figure").alias("kind"), F.col("no").cast("string").alias("target"), (F.col("page_no") + 1).alias("page_no"), "rect.x", "rect.y")
    return L.merged_crossrefs(found, _links(spark, sf_dir).where("kind = 'destination'"), targets)


def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _rects(spark, sf_dir).where("no % 2 = 1").select("doc_id", "page_no", F.lit(0).alias("line_no"), F.col("no").alias("item_no"), F.concat(F.lit("w"), F.col("no").cast("string")).alias("text"), "rect")
    return L.link_texts(_links(spark, sf_dir), items)


def link_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.addresses(_links(spark, sf_dir)).drop("rect")


def native_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _rects(spark, sf_dir).groupBy("doc_id").agg((F.count(F.lit(1)) >= 5).alias("usable"))
    return L.native_fallback(_links(spark, sf_dir), usable).select("doc_id", "page_no", "link_no", "confidence")


def upright_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, sf_dir).withColumns({"raw_top": F.when((F.col("link_no") == 4) & (F.col("doc_id") % 2 == 0), 9.0).otherwise(1.0), "raw_bottom": F.lit(5.0)})
    return L.upright(rows).select("doc_id", "page_no", "link_no", "rect.y")


def nearest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    points = rows.where("no % 2 = 0").select("doc_id", "page_no", F.col("no").alias("point_no"), "rect.x", "rect.y")
    return L.nearest_span(points, rows.where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("span_no"), "rect"))


def mention_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    return L.nearest_line(rows.where("no % 2 = 0").select("doc_id", "page_no", F.col("no").alias("ord"), "rect.y"), rows.where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("line_no"), F.col("rect.y").alias("original_y")))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_page_order(_rects(spark, sf_dir).select("doc_id", "page_no", F.col("no").alias("ord"), "rect.x", "rect.y")).select("doc_id", "page_no", "ord", "place")


QUERIES = {f.__name__: f for f in (citation_links, merged_citations, merged_crossrefs, link_texts, link_addresses, native_citations, upright_links, nearest_spans, mention_lines, page_order)}

_LINKS = f"""{_RECTS}, links AS (SELECT doc_id, page_no, no AS link_no, x, y, w, h, CASE WHEN no % 6 = 0 THEN 'action' ELSE 'destination' END AS kind, CASE WHEN no % 6 <> 0 THEN no % 3 END::INT AS dest_page, CASE WHEN no % 6 <> 0 THEN (x * (no % 4 - 1)) % 400 END AS dest_x, CASE WHEN no % 6 <> 0 THEN y + (no % 5) * 9 - 9 END AS dest_y, CASE WHEN no % 12 = 0 THEN 'https://h/' || no END AS uri FROM rects WHERE no % 2 = 0),
odd AS (SELECT * FROM rects WHERE no % 2 = 1)"""
ORACLES = {
    "citation_links": f"""{_LINKS}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, floor(x + 0.5), floor(y + 0.5) ORDER BY link_no DESC) AS nth FROM links WHERE kind = 'destination' AND NOT (page_no > doc_id % 2 AND page_no <= 2) AND dest_page + 1 >= doc_id % 2),
      n AS (SELECT l.doc_id, l.page_no, l.link_no, arg_min(a.no, (abs(a.y - dest_y) + CASE WHEN dest_x <> 0 THEN abs(a.x - dest_x) ELSE 0 END, a.no)) AS ref, min(abs(a.y - dest_y) + CASE WHEN dest_x <> 0 THEN abs(a.x - dest_x) ELSE 0 END) AS off FROM l JOIN odd a ON a.doc_id = l.doc_id AND a.page_no = l.dest_page AND a.y <= l.dest_y WHERE nth = 1 AND dest_y <> 0 GROUP BY 1, 2, 3)
      SELECT l.doc_id, l.page_no, l.link_no, dest_y <> 0 AS valid, CASE WHEN off < 50 THEN ref END::VARCHAR AS ref_index FROM l LEFT JOIN n USING (doc_id, page_no, link_no) WHERE nth = 1""",
    # a page's list of citations as a state; its links in order, each to the first that it overlaps, or to the list's end
    "merged_citations": f"""{_LINKS.replace("WITH ", "WITH RECURSIVE ", 1)}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, floor(x + 0.5), floor(y + 0.5) ORDER BY link_no DESC) AS last FROM links WHERE kind = 'destination' AND NOT (page_no > doc_id % 2 AND page_no <= 2) AND dest_page + 1 >= doc_id % 2),
      n AS (SELECT l.doc_id, l.page_no, l.link_no, arg_min(a.no, (abs(a.y - dest_y) + CASE WHEN dest_x <> 0 THEN abs(a.x - dest_x) ELSE 0 END, a.no)) AS ref, min(abs(a.y - dest_y) + CASE WHEN dest_x <> 0 THEN abs(a.x - dest_x) ELSE 0 END) AS off FROM l JOIN odd a ON a.doc_id = l.doc_id AND a.page_no = l.dest_page AND a.y <= l.dest_y WHERE last = 1 AND dest_y <> 0 GROUP BY 1, 2, 3),
      k AS MATERIALIZED (SELECT l.doc_id, l.page_no, l.x, l.y, l.w, l.h, l.dest_page, CASE WHEN off < 50 AND dest_y <> 0 THEN ref END::VARCHAR AS ref, row_number() OVER (PARTITION BY l.doc_id, l.page_no ORDER BY l.link_no) AS nth FROM l LEFT JOIN n USING (doc_id, page_no, link_no) WHERE last = 1),
      c AS (SELECT doc_id, page_no, floor(x + 0.5)::BIGINT AS px, floor(y + 0.5)::BIGINT AS py, min(no) AS turn, arg_min({{'px': floor(x + 0.5)::BIGINT, 'py': floor(y + 0.5)::BIGINT, 'x': x, 'y': y, 'w': w, 'h': h, 'kind': ['numeric', 'author-year', 'abbreviated'][no % 3 + 1], 'refs': [no::VARCHAR, (no + 2)::VARCHAR], 'sure': confidence, 'flags': 0, 'dest': NULL::INT}}, (-confidence, no)) AS c FROM odd GROUP BY ALL),
      st AS (SELECT doc_id, page_no, 0::BIGINT AS nth, coalesce(list(c ORDER BY turn) FILTER (turn IS NOT NULL), []) AS held FROM (SELECT DISTINCT doc_id, page_no FROM rects) LEFT JOIN c USING (doc_id, page_no) GROUP BY ALL
        UNION ALL SELECT doc_id, page_no, nth, CASE
            WHEN hit IS NOT NULL THEN list_concat(held[: hit - 1], [{{'px': o.px, 'py': o.py, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'kind': o.kind, 'refs': CASE WHEN leads AND NOT agrees THEN [ref] ELSE o.refs END, 'sure': CASE WHEN agrees THEN least(1.0, o.sure + 0.2) ELSE o.sure END, 'flags': o.flags | CASE WHEN agrees THEN 3 ELSE 1 END, 'dest': CASE WHEN leads THEN dest_page ELSE o.dest END}}], held[hit + 1 :])
            WHEN same IS NOT NULL THEN list_concat(held[: same - 1], [own], held[same + 1 :]) ELSE list_append(held, own) END
          FROM (SELECT *, held[hit] AS o, coalesce(ref IS NOT NULL AND list_contains(held[hit].refs, ref), false) AS agrees, coalesce(ref IS NOT NULL AND (list_contains(held[hit].refs, ref) OR held[hit].kind NOT IN ('numeric', 'abbreviated')), false) AS leads FROM (
            SELECT k.*, st.held, {{'px': floor(k.x + 0.5)::BIGINT, 'py': floor(k.y + 0.5)::BIGINT, 'x': k.x, 'y': k.y, 'w': k.w, 'h': k.h, 'kind': 'imported', 'refs': [k.ref], 'sure': 0.85::DOUBLE, 'flags': 3, 'dest': k.dest_page}} AS own,
              list_min(list_filter(range(1, len(st.held) + 1), lambda i: st.held[i].x < k.x + k.w - 5 AND st.held[i].x + st.held[i].w > k.x + 5 AND st.held[i].y < k.y + k.h - 5 AND st.held[i].y + st.held[i].h > k.y + 5)) AS hit,
              list_min(list_filter(range(1, len(st.held) + 1), lambda i: st.held[i].px = floor(k.x + 0.5) AND st.held[i].py = floor(k.y + 0.5))) AS same
            FROM st JOIN k ON k.doc_id = st.doc_id AND k.page_no = st.page_no AND k.nth = st.nth + 1))),
      e AS (SELECT doc_id, page_no, list_filter(arg_max(held, nth), lambda c: c.sure >= 0.3) AS held FROM st GROUP BY 1, 2),
      u AS (SELECT doc_id, page_no, unnest(range(len(held))) AS place, unnest(held) AS c FROM e)
      SELECT doc_id, page_no::INT AS page_no, place::INT AS place, c.kind AS type, array_to_string(list_transform(c.refs, lambda r: coalesce(r, 'null')), ',') AS refs, round(c.sure, 6) AS confidence, c.flags AS flags, c.dest AS dest_page FROM u""",
    "merged_crossrefs": f"""{_LINKS}, f AS (SELECT *, ['figure', 'table'][(no % 4) // 2 + 1] AS kind, row_number() OVER (PARTITION BY doc_id, page_no, floor(x + 0.5), floor(y + 0.5) ORDER BY no DESC) AS nth FROM odd),
      m AS (SELECT l.*, (SELECT min(f.no) FROM f WHERE nth = 1 AND f.doc_id = l.doc_id AND f.page_no = l.page_no AND f.x < l.x + l.w + 5 AND f.x + f.w + 5 > l.x AND f.y < l.y + l.h + 5 AND f.y + f.h + 5 > l.y) AS ref FROM links l WHERE kind = 'destination'),
      b AS (SELECT doc_id, ref, max(link_no) AS link_no FROM m WHERE ref IS NOT NULL GROUP BY 1, 2)
      SELECT f.doc_id, f.page_no, f.no AS ord, f.kind, f.no::VARCHAR AS target, CASE WHEN b.ref IS NOT NULL THEN l.dest_page ELSE t.page_no END::INT AS to_page, CASE WHEN b.ref IS NOT NULL THEN l.dest_x ELSE t.x END AS to_x, CASE WHEN b.ref IS NOT NULL THEN l.dest_y ELSE t.y END AS to_y, b.ref IS NOT NULL AS by_link
      FROM f LEFT JOIN b ON b.doc_id = f.doc_id AND b.ref = f.no LEFT JOIN links l ON l.doc_id = f.doc_id AND l.link_no = b.link_no LEFT JOIN rects t ON t.doc_id = f.doc_id AND t.no = f.no AND t.no % 3 = 0 AND f.kind = 'figure' WHERE nth = 1""",
    "link_texts": f"""{_LINKS} SELECT l.doc_id, l.page_no, l.link_no, string_agg('w' || a.no, ' ' ORDER BY a.no) AS text FROM links l JOIN odd a ON a.doc_id = l.doc_id AND a.page_no = l.page_no AND a.x < l.x + l.w AND l.x < a.x + a.w AND a.y < l.y + l.h AND l.y < a.y + a.h GROUP BY 1, 2, 3""",
    "link_addresses": f"{_LINKS} SELECT doc_id, page_no, link_no, uri FROM links WHERE uri IS NOT NULL",
    "native_citations": f"{_LINKS} SELECT doc_id, page_no, link_no, 1.0::DOUBLE AS confidence FROM links WHERE kind = 'destination' AND dest_y <> 0 AND doc_id IN (SELECT doc_id FROM rects GROUP BY 1 HAVING count(*) < 5)",
    "upright_links": f"""{_LINKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY link_no) AS nth FROM links), t AS (SELECT doc_id, page_no, bool_or(nth <= 5 AND link_no = 4 AND doc_id % 2 = 0) AS turned FROM n GROUP BY 1, 2) SELECT doc_id, page_no, link_no, CASE WHEN turned THEN y - h ELSE y END AS y FROM n JOIN t USING (doc_id, page_no)""",
    "nearest_spans": f"""{_LINKS} SELECT l.doc_id, l.page_no, l.link_no AS point_no, arg_min(a.no, (greatest(a.x - l.x, l.x - a.x - a.w, 0) ** 2 + 4 * greatest(a.y - l.y, l.y - a.y - a.h, 0) ** 2, a.no)) AS span_no FROM links l JOIN odd a ON a.doc_id = l.doc_id AND a.page_no = l.page_no GROUP BY 1, 2, 3""",
    "mention_lines": f"{_LINKS} SELECT l.doc_id, l.page_no, l.link_no AS ord, arg_min(a.no, (abs(a.y - l.y), a.no)) AS line_no FROM links l JOIN odd a ON a.doc_id = l.doc_id AND a.page_no = l.page_no WHERE abs(a.y - l.y) < 10 GROUP BY 1, 2, 3",
    "page_order": f"{_RECTS} SELECT doc_id, page_no, no AS ord, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY floor(y / 5), x, no) - 1)::INT AS place FROM rects",
}
