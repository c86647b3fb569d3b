"""Queries over rectangles, trees and reading history, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import spatial, trails, trees
from foliograph.sources.adapters import table


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rectangles on pages: an order is a document, three pages each; whole rows are numbered by all columns."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("no", F.row_number().over(order).cast("long"))
    rect = F.struct((F.col("l_partkey") % 50 * 10.0).alias("x"), (F.col("l_suppkey") % 20 * 7.0).alias("y"), (F.col("l_quantity") + 20.0).alias("w"), F.lit(12.0).alias("h"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page_no"), "no", rect.alias("rect"), (F.col("l_quantity") % 10 / 10).alias("confidence"))


def rect_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    links = rows.where("no % 2 = 0").select("doc_id", "page_no", F.col("no").alias("link_no"), "rect")
    return spatial.first_overlap(links, rows.where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("cit_no"), "rect"))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir).select("doc_id", "page_no", "no", "rect.x", "rect.y")
    points = rows.where("no % 2 = 0").withColumnRenamed("no", "point_no")
    return spatial.nearest_anchor(points, rows.where("no % 2 = 1").withColumnRenamed("no", "anchor_no"))


def containing_section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir).select("doc_id", "page_no", "no", "rect.y")
    return spatial.containing_section(rows.where("no % 2 = 0").withColumnRenamed("no", "point_no"), rows.where("no % 2 = 1").withColumnRenamed("no", "section_no"))


def containing_section_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = F.when(F.col("no") % 5 == 0, -1).when(F.col("x") > 250, 1).otherwise(0)
    rows = _rects(spark, sf_dir).select("doc_id", "page_no", "no", "rect.x", "rect.y").withColumn("column", column)
    return spatial.containing_section_by_columns(rows.where("no % 2 = 0").withColumnRenamed("no", "point_no").withColumn("y", F.col("y") + 0.5), rows.where("no % 2 = 1").withColumnRenamed("no", "section_no").withColumn("y", F.col("y") + F.col("section_no") / 1000))


def position_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.best_by_place(_rects(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), F.col("no").alias("ord"), (F.col("rect.x") / 100).alias("x"), (F.col("rect.y") / 100).alias("y"), "confidence"))


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bounding_boxes(_rects(spark, sf_dir), ["doc_id", "page_no"])


def line_rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merged_rects(_rects(spark, sf_dir).select("doc_id", "page_no", F.lit(1).alias("line_no"), "rect.x", "rect.w"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations, and their suppliers as a tree."""
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey * 1000000 AS node_id", "CAST(NULL AS BIGINT) AS parent_id", "r_name AS title", "r_regionkey AS tree_id")
    nation = table(spark, sf_dir, "nation").selectExpr("n_regionkey * 1000000 + 1000 * (n_nationkey + 1) AS node_id", "n_regionkey * 1000000 AS parent_id", "n_name AS title", "n_regionkey AS tree_id", "n_nationkey")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("100000000 + s_suppkey AS node_id", "node_id AS parent_id", "s_name AS title", "tree_id")
    return region.unionByName(nation.drop("n_nationkey")).unionByName(supplier).selectExpr("CAST(tree_id AS BIGINT) AS tree_id", "CAST(node_id AS BIGINT) AS node_id", "CAST(parent_id AS BIGINT) AS parent_id", "CAST(node_id AS BIGINT) AS ord", "title")


def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flattened(_tree(spark, sf_dir))


def tree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.laid_out(_tree(spark, sf_dir))


def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey * 100 + l_linenumber AS ord", "IF(l_quantity % 2 = 0, CAST(l_linenumber AS STRING), concat(l_linenumber, '.', CAST(l_quantity AS INT))) AS prefix", "IF(l_quantity % 2 = 0, 1, 2) AS level")
    return trees.outline(rows.groupBy("doc_id", "ord").agg(F.min("prefix").alias("prefix"), F.min("level").alias("level")))


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows if kind is None else rows.where(F.col("event_type") == kind)


def _papers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of each reader, a hundred times as fast, with a title and an address each by the event's key; every other click has no address."""
    titles = F.array(*(F.lit(t) for t in PAPERS))
    url = F.concat(F.lit("https://Papers.org/p/"), (F.col("event_id") % 3).cast("string"))
    rows = _events(spark, sf_dir, kind).withColumn("url", F.when((F.col("event_id") % 2 == 0) | (F.col("event_type") == "view"), url))
    ts = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100))
    return rows.select("user_id", "event_id", ts.alias("ts"), F.get(titles, (F.col("event_id") % len(PAPERS)).cast("int")).alias("title"), "url")


#: titles of four papers; the first two agree
PAPERS = ("Graph Neural Networks", "Graph neural networks: for molecules", "Deep Learning", "Attention, and what it needs")


def pending_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.matched(_papers(spark, sf_dir, "click"), _papers(spark, sf_dir, "view"))


def trail_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    norm = F.concat(F.lit("title "), (F.col("event_id") % 40).cast("string"))
    nodes = rows.where("event_type = 'signup'").select((F.col("event_id") % 20).alias("trail_id"), F.col("event_id").alias("node_id"), norm.alias("title_norm"), F.col("event_id").alias("ord"))
    matches = rows.where("event_type = 'view'").select(F.col("event_id").alias("open_id"), F.concat(F.lit("title "), (F.col("event_id") % 55).cast("string")).alias("source"))
    return trails.connected(matches, nodes)


def trail_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    of = rows.select("event_type", (F.col("event_id") % 7).alias("trail_id"), (F.col("user_id") % 5).alias("parent_id"), F.col("event_id").alias("node_id"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("t"), (F.col("event_id") % 9).cast("string"))).otherwise("").alias("title_norm"), F.col("event_id").alias("ord"))
    return trails.added_children(of.where("event_type = 'signup'").drop("event_type"), of.where("event_type = 'view'").drop("event_type")).select("trail_id", "parent_id", "node_id")


def trails_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("DAY", "ts").alias("day")).agg(F.max("ts").alias("last_ts"), F.min("event_id").alias("trail_id"))
    nodes = rows.where("trail_id % 4 = 0").select("trail_id", F.lit("here").alias("title_norm"))
    return trails.shown(rows.select("user_id", "trail_id", (F.col("trail_id") % 3 == 0).alias("starred"), "last_ts"), nodes, "here")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 3).alias("client"), (F.col("event_id") % 5).alias("key"), "event_id", "ts", (F.col("event_id") % 4 != 0).alias("ok"))
    return trails.looked_up(rows, 86400).select("event_id", "real")


def spaced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 40).alias("client"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return trails.spaced(rows, 7200).select("event_id", (F.col("starts") - F.col("at")).alias("wait"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: _events(spark, sf_dir, kind).select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("url"), "event_id", "ts")
    return trails.passed(of("click"), of("view"), 86400)


def sections_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([(k, k / 10) for k in range(1, 10)], "section_no long, position double")
    return trails.progress(_events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_id") % 97 / 97).alias("progress")), sections)


def slot_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: _events(spark, sf_dir, kind).select((F.col("user_id") % 9).alias("slot"), "event_id", "ts")
    return trails.slot_taken(of("click"), of("view"))


def pending_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.waiting(_events(spark, sf_dir, "click"))


def pending_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.fresh(_events(spark, sf_dir, "click"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id", "user_id")


def trail_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("DAY", "ts").alias("day")).agg(F.max("ts").alias("last_ts"), F.min("event_id").alias("trail_id"))
    return trails.pruned(rows.select("user_id", "trail_id", (F.col("trail_id") % 3 == 0).alias("starred"), "last_ts")).select("user_id", "trail_id", "starred")


def search_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.settled(_events(spark, sf_dir), 3600.0).select("user_id", "event_id")


def progress_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trails.milestones(_events(spark, sf_dir))


QUERIES = {f.__name__: f for f in (rect_overlap_join, nearest_anchor, containing_section_asof, containing_section_columns, position_dedup, bounding_boxes, line_rect_merge, outline_flatten, tree_layout, outline_tree, pending_match, trail_connections, trail_children, trails_shown, lookups, spaced_requests, passes, sections_reached, slot_takes, pending_cap, pending_lifetime, trail_prune, search_debounce, progress_milestones)}

_RECTS = """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS no FROM lineitem),
rects AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page_no, no, (l_partkey % 50 * 10)::DOUBLE AS x, (l_suppkey % 20 * 7)::DOUBLE AS y, l_quantity + 20.0::DOUBLE AS w, 12.0::DOUBLE AS h, l_quantity % 10 / 10 AS confidence FROM numbered)"""
ORACLES = {
    # the headings of each document one after the other; the topmost one above that a heading may lie below ends its way up
    "outline_tree": """WITH RECURSIVE h AS (SELECT l_orderkey AS doc_id, l_partkey * 100 + l_linenumber AS ord, min(CASE WHEN l_quantity % 2 = 0 THEN l_linenumber::VARCHAR ELSE l_linenumber || '.' || l_quantity::INT END) AS prefix, min(CASE WHEN l_quantity % 2 = 0 THEN 1 ELSE 2 END) AS level FROM lineitem GROUP BY 1, 2),
      n AS (SELECT doc_id, ord, level, list_transform(string_split(prefix, '.'), lambda x: x::INT) AS parts, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM h),
      st AS (SELECT DISTINCT doc_id, 0::BIGINT AS nth, []::STRUCT(ord BIGINT, level INT, parts INT[])[] AS above, 0 AS largest, NULL::BIGINT AS ord, NULL::BIGINT AS parent, false AS kept FROM n
        UNION ALL SELECT doc_id, nth, CASE WHEN ok THEN list_append(above, {'ord': ord, 'level': level, 'parts': parts}) ELSE above END, CASE WHEN ok AND len(above) = 0 THEN greatest(largest, parts[1]) ELSE largest END, ord, above[-1].ord, ok
          FROM (SELECT n.doc_id, n.nth, n.ord, n.level, n.parts, st.largest, st.above[1 : coalesce(list_max(list_filter(range(1, len(st.above) + 1), lambda i: st.above[i].level < n.level AND len(st.above[i].parts) < len(n.parts) AND n.parts[1 : len(st.above[i].parts)] = st.above[i].parts)), 0)] AS above FROM st JOIN n ON n.doc_id = st.doc_id AND n.nth = st.nth + 1),
            LATERAL (SELECT len(above) > 0 OR (len(parts) = 1 AND (largest = 0 OR parts[1] <= largest + 5)) AS ok))
      SELECT doc_id, ord, parent FROM st WHERE kept""",
    "tree_layout": """WITH leaves AS (SELECT r_regionkey AS tree_id, 100000000 + s_suppkey AS node_id, n_regionkey * 1000000 + 1000 * (n_nationkey + 1) AS parent, 2 AS depth FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_regionkey, n_regionkey * 1000000 + 1000 * (n_nationkey + 1), n_regionkey * 1000000 + 1000 * (n_nationkey + 1), 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)),
      y AS (SELECT *, 64.0 * (row_number() OVER (PARTITION BY tree_id ORDER BY parent, node_id) - 1) AS y FROM leaves),
      n AS (SELECT tree_id, parent AS node_id, (arg_min(y, node_id) + arg_max(y, node_id)) / 2 AS y FROM y GROUP BY 1, 2),
      r AS (SELECT tree_id, tree_id * 1000000 AS node_id, (arg_min(y, node_id) + arg_max(y, node_id)) / 2 AS y FROM n GROUP BY 1)
      SELECT tree_id::BIGINT AS tree_id, node_id::BIGINT AS node_id, 480.0::DOUBLE AS x, y::DOUBLE AS y FROM y WHERE depth = 2 UNION ALL SELECT tree_id, node_id, 240.0, y FROM n UNION ALL SELECT tree_id, node_id, 0.0, y FROM r""",
    "rect_overlap_join": f"""{_RECTS} SELECT a.doc_id, a.page_no, a.no AS link_no, min(b.no) AS cit_no FROM rects a LEFT JOIN rects b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.no % 2 = 1
      AND a.x < b.x + b.w - 5 AND a.x + a.w - 5 > b.x AND a.y < b.y + b.h - 5 AND a.y + a.h - 5 > b.y WHERE a.no % 2 = 0 GROUP BY 1, 2, 3""",
    "nearest_anchor": f"""{_RECTS}, d AS (SELECT a.doc_id, a.page_no, a.no AS point_no, b.no AS anchor_no, abs(b.y - a.y) + CASE WHEN a.x = 0 THEN 0 ELSE abs(b.x - a.x) END AS distance FROM rects a JOIN rects b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.no % 2 = 0 AND b.no % 2 = 1 AND b.y <= a.y)
      SELECT doc_id, page_no, point_no, arg_min(anchor_no, (distance, anchor_no)) AS anchor_no, min(distance) AS distance FROM d GROUP BY 1, 2, 3 HAVING min(distance) < 50""",
    "containing_section_asof": f"""{_RECTS}, c AS (SELECT a.doc_id, a.no AS point_no, b.no AS section_no, row_number() OVER (PARTITION BY a.doc_id, a.no ORDER BY b.page_no DESC NULLS LAST, b.y, b.no DESC) AS nth
        FROM rects a LEFT JOIN rects b ON a.doc_id = b.doc_id AND b.no % 2 = 1 AND (b.page_no < a.page_no OR (b.page_no = a.page_no AND b.y >= a.y)) WHERE a.no % 2 = 0)
      SELECT doc_id, point_no, section_no FROM c WHERE nth = 1""",
    "containing_section_columns": f"""{_RECTS}, p AS (SELECT doc_id, page_no, no, CASE WHEN no % 2 = 0 THEN y + 0.5 ELSE y + no / 1000 END AS y, CASE WHEN no % 5 = 0 THEN -1 WHEN x > 250 THEN 1 ELSE 0 END AS col FROM rects),
      b AS (SELECT a.doc_id, a.no, a.page_no, a.col, a.y, count(*) FILTER (o.col = -1) AS band FROM p a JOIN p o ON a.doc_id = o.doc_id AND a.page_no = o.page_no AND o.y >= a.y GROUP BY ALL),
      r AS (SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, band, col, y DESC, no % 2 = 0, no) AS place FROM b)
      SELECT a.doc_id, a.no AS point_no, arg_max(s.no, s.place) AS section_no FROM r a LEFT JOIN r s ON s.doc_id = a.doc_id AND s.no % 2 = 1 AND s.place < a.place WHERE a.no % 2 = 0 GROUP BY 1, 2""",
    "position_dedup": f"""{_RECTS} SELECT doc_id, 1 AS page_no, floor(x / 100 + 0.5)::BIGINT AS rx, floor(y / 100 + 0.5)::BIGINT AS ry, arg_min(no, (-confidence, no)) AS ord, max(confidence) AS confidence FROM rects GROUP BY 1, 3, 4""",
    "bounding_boxes": f"""{_RECTS} SELECT doc_id, page_no, min(x) AS "left", min(y) AS top, max(x + w) AS "right", max(y + h) AS bottom FROM rects GROUP BY 1, 2""",
    "line_rect_merge": f"""{_RECTS}, r AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id, page_no ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rects),
      i AS (SELECT *, sum(CASE WHEN x > reach + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS island FROM r)
      SELECT doc_id, page_no, 1 AS line_no, island::BIGINT AS island, min(x) AS "left", max(x + w) AS "right", count(*) AS n FROM i GROUP BY 1, 2, island""",
    "outline_flatten": """SELECT r_regionkey * 1000000 AS node_id, 0 AS depth, r_name AS path FROM region
      UNION ALL SELECT n_regionkey * 1000000 + 1000 * (n_nationkey + 1), 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 100000000 + s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pending_match": """WITH RECURSIVE ev AS (SELECT user_id AS u, make_timestamp(epoch_us(ts) // 100) AS ts, event_type = 'view' AS opens, event_id, [1, 1, 2, 3][event_id % 4 + 1] AS title, CASE WHEN event_id % 2 = 0 OR event_type = 'view' THEN event_id % 3 END AS url, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 100, event_type = 'view', event_id) AS nth FROM events WHERE event_type IN ('click', 'view')),
      st AS (SELECT DISTINCT u, 0::BIGINT AS nth, []::STRUCT(t TIMESTAMP, id BIGINT, title INT, url BIGINT)[] AS w, NULL::BIGINT AS open_id, NULL::BIGINT AS click_id FROM ev
        UNION ALL SELECT u, nth, CASE WHEN NOT opens THEN list_append(w, {'t': ts, 'id': event_id, 'title': title, 'url': url})[-5:] WHEN hit IS NULL THEN w ELSE list_filter(w, lambda c: c.t <> hit.t) END, CASE WHEN opens AND hit IS NOT NULL THEN event_id END, CASE WHEN opens THEN hit.id END
          FROM (SELECT e.*, st.w, list_filter(st.w, lambda c: c.t >= e.ts - INTERVAL 10 MINUTE AND (c.title = e.title OR c.url = e.url))[1] AS hit FROM st JOIN ev e ON e.u = st.u AND e.nth = st.nth + 1))
      SELECT open_id, click_id FROM st WHERE open_id IS NOT NULL""",
    "trail_connections": """WITH n AS (SELECT event_id % 40 AS t, arg_min(event_id % 20, event_id) AS trail_id, min(event_id) AS node_id FROM events WHERE event_type = 'signup' GROUP BY 1)
      SELECT event_id AS open_id, coalesce(trail_id, event_id) AS trail_id, node_id AS parent_id, t IS NULL AS new FROM events LEFT JOIN n ON event_id % 55 = t WHERE event_type = 'view'""",
    "trail_children": """WITH n AS (SELECT event_id % 7 AS trail_id, user_id % 5 AS parent_id, event_id AS node_id, CASE WHEN event_id % 11 > 0 THEN event_id % 9 END AS t, event_type = 'view' AS new FROM events WHERE event_type IN ('signup', 'view')),
      k AS (SELECT *, row_number() OVER (PARTITION BY trail_id, parent_id, t ORDER BY new, node_id) AS nth FROM n) SELECT trail_id, parent_id, node_id FROM k WHERE NOT new OR t IS NULL OR nth = 1""",
    "trails_shown": """WITH t AS (SELECT user_id, date_trunc('day', ts) AS d, max(ts) AS last_ts, min(event_id) AS trail_id FROM events GROUP BY 1, 2), c AS (SELECT *, trail_id % 4 = 0 AS current, trail_id % 3 = 0 AS starred FROM t),
      k AS (SELECT *, row_number() OVER (PARTITION BY user_id, current ORDER BY starred DESC, last_ts DESC, trail_id) AS nth FROM c)
      SELECT user_id, trail_id, current, (row_number() OVER (PARTITION BY user_id ORDER BY current DESC, starred DESC, last_ts DESC, trail_id) - 1)::INT AS place FROM k WHERE current OR nth <= 5""",
    "lookups": """WITH RECURSIVE ev AS (SELECT user_id % 3 AS c, event_id % 5 AS k, event_id, ts, event_id % 4 <> 0 AS ok, row_number() OVER (PARTITION BY user_id % 3, event_id % 5 ORDER BY ts, event_id) AS nth FROM events),
      st AS (SELECT DISTINCT c, k, 0::BIGINT AS nth, NULL::TIMESTAMP AS good, NULL::BIGINT AS event_id, false AS sent FROM ev
        UNION ALL SELECT e.c, e.k, e.nth, CASE WHEN e.ok AND (st.good IS NULL OR e.ts - st.good >= INTERVAL 1 DAY) THEN e.ts ELSE st.good END, e.event_id, st.good IS NULL OR e.ts - st.good >= INTERVAL 1 DAY FROM st JOIN ev e ON e.c = st.c AND e.k = st.k AND e.nth = st.nth + 1)
      SELECT event_id, sent AS real FROM st WHERE event_id IS NOT NULL""",
    "spaced_requests": """WITH RECURSIVE ev AS (SELECT user_id % 40 AS c, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS nth FROM events),
      st AS (SELECT c, nth, event_id, t, t AS s FROM ev WHERE nth = 1 UNION ALL SELECT e.c, e.nth, e.event_id, e.t, greatest(e.t, st.s + 7200000000) FROM st JOIN ev e ON e.c = st.c AND e.nth = st.nth + 1)
      SELECT event_id, s - t AS wait FROM st""",
    "passes": """WITH e AS (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS held, lag(ts) OVER w AS given FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id % 50 ORDER BY ts, event_type = 'view', event_id))
      SELECT event_id AS page_id, held AS permit_id FROM e WHERE event_type = 'view' AND before = 'click' AND ts - given <= INTERVAL 1 DAY""",
    "sections_reached": """SELECT user_id, k AS section_no, arg_min(event_id, (ts, event_id)) AS event_id FROM events, range(1, 10) r(k) WHERE event_id % 97 / 97 >= k / 10 - 0.01 GROUP BY 1, 2""",
    "slot_takes": """WITH e AS (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS held FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id % 9 ORDER BY ts, event_type = 'view', event_id))
      SELECT event_id AS take_id, held AS put_id FROM e WHERE event_type = 'view' AND before = 'click'""",
    "pending_cap": "SELECT user_id, event_id, nth::INT AS nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type = 'click') WHERE nth <= 5",
    "pending_lifetime": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-14 23:50:00'",
    "trail_prune": """WITH t AS (SELECT user_id, date_trunc('day', ts) AS d, max(ts) AS last_ts, min(event_id) AS trail_id FROM events GROUP BY 1, 2),
      r AS (SELECT *, trail_id % 3 = 0 AS starred, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, trail_id % 3 = 0 ORDER BY last_ts, trail_id) AS nth FROM t)
      SELECT user_id, trail_id, starred FROM r WHERE NOT (n > 8 AND NOT starred AND nth = 1)""",
    "search_debounce": "SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR nx - ts > INTERVAL 3600 SECOND",
    "progress_milestones": "SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b",
}
