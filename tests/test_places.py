"""Grid joins and nearest targets on one page of 50,000 rectangles, and against all pairs."""

import random

from pyspark.sql import functions as F

from foliograph.operators import links, spatial

RECT = "struct<x:double,y:double,w:double,h:double>"


def some_rects(seed, n, pages=1):
    rng = random.Random(seed)
    return [(1, rng.randrange(pages), k, (round(rng.uniform(-80, 650), 1), round(rng.uniform(-60, 850), 1), rng.choice([0.0, 3.0, 12.0, 70.0, 900.0]), rng.choice([0.0, 4.0, 12.0, 40.0]))) for k in range(n)]


def meet(a, b, t):
    return a[0] < b[0] + b[2] + t and a[0] + a[2] + t > b[0] and a[1] < b[1] + b[3] + t and a[1] + a[3] + t > b[1]


def test_meeting_is_all_pairs_once(spark):
    left, right = some_rects(1, 150, 2), some_rects(2, 150, 2)
    left += [(1, 0, 900, None), (1, 0, 901, (1e12, 5.0, 10.0, 10.0)), (1, 0, 902, (-1e12, 5.0, 2e12, 10.0))]
    right += [(1, 0, 901, (1e12, 5.0, 10.0, 10.0))]
    a = spark.createDataFrame(left, f"doc_id long, page_no long, i long, a {RECT}")
    b = spark.createDataFrame(right, f"doc_id long, page_no long, j long, b {RECT}")
    for t in (-5.0, 0.0, 5.0):
        got = sorted((r.i, r.j) for r in spatial.meeting(a, b, t).collect())
        assert got == sorted((x[2], y[2]) for x in left for y in right if x[1] == y[1] and x[3] and meet(x[3], y[3], t))


def test_nearest_is_the_least_of_all(spark):
    rng = random.Random(3)
    boxes = some_rects(4, 120, 2)
    points = [(1, rng.randrange(3), k, rng.choice([0.0, round(rng.uniform(-2000, 4000), 1)]), round(rng.uniform(-50, 900), 1)) for k in range(120)] + [(1, 0, 500, None, 3.0)]
    p = spark.createDataFrame(points, "doc_id long, page_no long, point_no long, x double, y double")
    b = spark.createDataFrame(boxes, f"doc_id long, page_no long, no long, rect {RECT}")
    spans = {r.point_no: r.span_no for r in links.nearest_span(p, b.withColumnRenamed("no", "span_no")).collect()}
    anchors = b.select("doc_id", "page_no", F.col("no").alias("anchor_no"), "rect.x", "rect.y")
    below = {r.point_no: r.anchor_no for r in spatial.nearest_anchor(p, anchors).collect()}
    lines = {r.ord: r.line_no for r in links.nearest_line(p.withColumnRenamed("point_no", "ord"), b.select("doc_id", "page_no", F.col("no").alias("line_no"), F.col("rect.y").alias("original_y"))).collect()}
    off = lambda low, at, size: max(low - at, at - low - size, 0)
    for _, page, k, x, y in points:
        own = [r for r in boxes if r[1] == page]
        if x is None or not own:
            assert k not in spans
            continue
        assert spans[k] == min((off(r[3][0], x, r[3][2]) ** 2 + 4 * off(r[3][1], y, r[3][3]) ** 2, r[2]) for r in own)[1]
        best = min(((abs(r[3][1] - y) + (abs(r[3][0] - x) if x else 0), r[2]) for r in own if r[3][1] <= y), default=(99, 0))
        assert below.get(k) == (best[1] if best[0] < 50 else None)
        best = min((abs(r[3][1] - y), r[2]) for r in own)
        assert lines.get(k) == (best[1] if best[0] < 10 else None)


def test_one_page_of_fifty_thousand(spark):
    n = 50_000
    rects = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.col("id").alias("no"), F.struct((F.col("id") % 250 * 2.4).alias("x"), (F.floor(F.col("id") / 250) * 3.9).alias("y"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h")).alias("rect"))
    a, b = rects.where("no % 2 = 0"), rects.where("no % 2 = 1")
    assert spatial.meeting(rects.withColumnRenamed("rect", "a"), rects.select("doc_id", "page_no", F.col("no").alias("m"), F.col("rect").alias("b")), 0.0).count() == n
    found = spatial.first_overlap(a.withColumnRenamed("no", "link_no"), b.withColumnRenamed("no", "cit_no"), 1.0)
    assert found.where("cit_no IS NULL").count() == 0
    points = a.select("doc_id", "page_no", F.col("no").alias("point_no"), (F.col("rect.x") + 2.0).alias("x"), "rect.y")
    near = links.nearest_span(points, b.withColumnRenamed("no", "span_no"))
    assert near.where("span_no = point_no + 1").count() == n // 2
    anchored = spatial.nearest_anchor(points, b.select("doc_id", "page_no", F.col("no").alias("anchor_no"), "rect.x", "rect.y"))
    assert anchored.where("anchor_no = point_no + 1").count() == n // 2
