"""Annotation geometry and reference sections on small cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliograph.operators import annotations as A
from foliograph.operators import references as R

STROKE = "id long, points array<struct<x:double,y:double>>"


def recursive(points, tolerance):
    if len(points) <= 2:
        return points
    (x1, y1), (x2, y2) = points[0], points[-1]
    size = math.hypot(x2 - x1, y2 - y1)
    off = [abs((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / size if size else math.hypot(x - x1, y - y1) for x, y in points[1:-1]]
    far = max(range(len(off)), key=lambda k: off[k])
    if off[far] <= tolerance:
        return [points[0], points[-1]]
    return recursive(points[: far + 2], tolerance)[:-1] + recursive(points[far + 1 :], tolerance)


def test_simplified_strokes(spark):
    rng = random.Random(1)
    strokes = [[(rng.random(), rng.random()) for _ in range(rng.randrange(0, 40))] for _ in range(30)] + [[(0.0, 0.0)] * 5]
    rows = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in s]) for i, s in enumerate(strokes)], STROKE)
    got = {r.id: [(p.x, p.y) for p in r.s] for r in rows.select("id", A.simplified(F.col("points"), 0.2).alias("s")).collect()}
    assert got == {i: recursive(s, 0.2) for i, s in enumerate(strokes)}


def test_brush_and_moves(spark):
    rows = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 4.0, "y": 0.0}])], STROKE)
    got = rows.select(A.lazy_brush(F.col("points"), 2.0).alias("b"), A.moved(F.col("points"), F.lit(1.0), F.lit(2.0)).alias("m"), A.scaled(F.col("points"), F.lit(2.0)).alias("s")).first()
    assert [p.x for p in got.b] == [0, 0, 2]
    assert [(p.x, p.y) for p in got.m] == [(1, 2), (2, 2), (5, 2)]
    assert [p.x for p in got.s] == [0, 2, 8]


def test_comments_find_marks(spark):
    marks = spark.createDataFrame([(1, 1, 10, 0.0, 0.0), (1, 1, 11, 30.0, 0.0), (1, 2, 12, 0.0, 0.0)], "doc_id long, page_no int, mark_id long, x double, y double")
    comments = spark.createDataFrame([(1, 1, 1, None, 2.0, 0.0), (1, 1, 2, None, 3.0, 0.0), (1, 2, 3, 12, 9.0, 9.0), (1, 2, 4, None, 0.0, 0.0), (1, 1, 5, None, 500.0, 0.0)], "doc_id long, page_no int, comment_id long, linked long, x double, y double")
    got = {(r.comment_id, r.mark_id) for r in A.commented(marks, comments, 612.0, 792.0).collect()}
    assert got == {(1, 10), (2, 11), (3, 12)}


def test_color_dots(spark):
    marks = spark.createDataFrame([(1, k, c) for k, c in enumerate("rrgbyb")], "section_id long, mark_id long, color string")
    r = A.color_dots(marks).first()
    assert (r.colors, r.extra) == ("r,g,b", 3)


def lines(spark, rows):
    return spark.createDataFrame([(1, p, i, t, x, y, w, 10.0, s) for i, (p, t, x, y, w, s) in enumerate(rows)], "doc_id long, page_no int, line_no int, text string, x double, y double, w double, h double, style int")


def test_sections(spark):
    rows = [(2, "References", 72.0, 400.0, 60.0, 1), (3, "text", 72.0, 700.0, 60.0, 0), (3, "7. REFERENCES", 72.0, 500.0, 60.0, 0), (3, "[1] A", 72.0, 480.0, 60.0, 0), (3, "[2] B", 72.0, 460.0, 60.0, 0), (3, "Appendix", 72.0, 440.0, 60.0, 1), (3, "more", 72.0, 420.0, 60.0, 0)]
    r = R.sections(lines(spark, rows)).first()
    assert (r.start_line, r.end_line) == (2, 4)
    assert R.line_gaps(lines(spark, rows[1:])).first().gap == 20.0


def test_shaped_entries(spark):
    wide, shape = 300.0, []
    for k in range(3):  # three hanging entries of two lines, the third after a page break
        shape += [(1 + k // 2, "Smith, J. Some title", 72.0, 700.0 - 24 * k, wide, 0), (1 + k // 2, "goes on here 2001.", 90.0, 688.0 - 24 * k, 120.0, 0)]
    rows = lines(spark, shape).select("*", F.lit(12.0).alias("gap"), F.lit(wide).alias("body_width"), F.lit(False).alias("straight"), F.lit(False).alias("author_year"))
    assert [r.entry for r in R.shaped_entries(rows).orderBy("line_no").collect()] == [1, 1, 2, 2, 3, 3]
    flat = rows.withColumn("w", F.lit(wide)).withColumn("x", F.lit(72.0)).withColumn("page_no", F.lit(1)).withColumn("text", F.lit("plain words")).withColumn("y", F.col("line_no") * -12.0 - F.when(F.col("line_no") >= 4, 10.0).otherwise(0.0))
    assert [r.entry for r in R.shaped_entries(flat).orderBy("line_no").collect()] == [1, 1, 1, 1, 2, 2]


def test_simplified_points_keep_ends():
    assert A.simplified_points(np.array([[0, 0], [1, 0], [2, 0.0]]), 0.1).tolist() == [True, False, True]
