"""Annotation geometry: strokes, ratios of the page, comments and the marks they belong to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from foliograph.functions.folds import cut

POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
#: how far a comment may be from its mark, as a share of the page's longer side
NEAR = 0.1


def simplified_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay when those within ``tolerance`` of the chords are left out (Douglas and Peucker)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, chord = points[a + 1 : b] - points[a], points[b] - points[a]
        size = float(np.sqrt(chord[0] * chord[0] + chord[1] * chord[1]))
        off = np.abs(chord[1] * inner[:, 0] - chord[0] * inner[:, 1]) / size if size else np.hypot(inner[:, 0], inner[:, 1])
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplified(column: Column, tolerance: float = 0.001) -> Column:
    """A stroke's points without those that its simplification can do without."""

    @F.pandas_udf(POINTS)
    def run(strokes: pd.Series) -> pd.Series:
        def one(stroke):
            if stroke is None or len(stroke) < 3:
                return stroke
            xy = np.array([(p["x"], p["y"]) for p in stroke], float)
            return [stroke[k] for k in np.flatnonzero(simplified_points(xy, tolerance))]

        return strokes.map(one)

    return run(column)


def brushed(points: np.ndarray, radius: float, friction: float = 0.0) -> np.ndarray:
    """Where a brush on a string of length ``radius`` is after each point."""
    out = np.empty_like(points)
    at = points[0].copy() if len(points) else None
    share = 1.0 - np.sqrt(1 - (1 - friction) ** 2) if 0 < friction < 1 else 1.0
    for k, p in enumerate(points):
        way = p - at
        far = float(np.hypot(*way))
        if far > radius:
            at = at + way * ((far - radius) / far * share)
        out[k] = at
    return out


def lazy_brush(column: Column, radius: float, friction: float = 0.0) -> Column:
    """Where a brush on a string of length ``radius`` is after each point: it moves only when pulled, straight towards the pointer,
    by what the string lacks; with a friction between 0 and 1 by less of it."""

    @F.pandas_udf(POINTS)
    def run(strokes: pd.Series) -> pd.Series:
        def one(stroke):
            if stroke is None or not len(stroke):
                return stroke
            return [{"x": x, "y": y} for x, y in brushed(np.array([(p["x"], p["y"]) for p in stroke], float), radius, friction).tolist()]

        return strokes.map(one)

    return run(column)


def moved(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scaled(points: Column, factor: Column, factor_y: Column | None = None) -> Column:
    """Points scaled about the top left corner of their bounds, by one factor or one each way."""
    left, top = (F.array_min(points.getField(c)) for c in ("x", "y"))
    down = factor if factor_y is None else factor_y
    return F.transform(points, lambda p: F.struct((left + (p["x"] - left) * factor).alias("x"), (top + (p["y"] - top) * down).alias("y")))


def resized(size: Column, by: Column, least: float = 20.0) -> Column:
    """The factor by which a drag of ``by`` resizes; a side stays ``least`` long."""
    return F.greatest(F.lit(least), size + by) / size


def rotation(before: Column, centre: Column, start: Column, end: Column) -> Column:
    """A rotation in degrees after a drag about ``centre`` from ``start`` to ``end``, all (x, y)."""
    angle = lambda p: F.atan2(p["y"] - centre["y"], p["x"] - centre["x"])
    return before + F.degrees(angle(end) - angle(start))


def absolute(ratio: Column, width: Column, height: Column) -> Column:
    """A rectangle of shares of the page in page units."""
    return F.struct((ratio["left_ratio"] * width).alias("x"), (ratio["top_ratio"] * height).alias("y"), (ratio["width_ratio"] * width).alias("w"), (ratio["height_ratio"] * height).alias("h"))


def subtree_dots(marks: DataFrame, below: DataFrame, most: int = 3) -> DataFrame:
    """As ``color_dots``, for the marks of a section and all sections below it; ``below (ancestor, node_id)`` has every section with those above it."""
    rows = marks.withColumnRenamed("section_id", "node_id").join(below, "node_id").select(F.col("ancestor").alias("section_id"), "mark_id", "color")
    return color_dots(rows, most)


def merged_ratio_rects(rects: DataFrame, gap: float = 0.01, high: float = 0.5) -> DataFrame:
    """Rectangles of an annotation's page (``mark_id, rect_no, x, y, w, h`` in shares of the page) joined where they are on one line (their middles
    less than ``high`` of the taller one's height apart) and no more than ``gap`` apart."""
    order = Window.partitionBy("mark_id").orderBy("y", "x", "rect_no")
    apart = F.abs(F.col("y") + F.col("h") / 2 - F.lag(F.col("y") + F.col("h") / 2).over(order)) >= high * F.greatest("h", F.lag("h").over(order))
    lined = rects.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    lined = lined.withColumn("line", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    across = Window.partitionBy("mark_id", "line").orderBy("x", "rect_no")
    reach = F.max(F.col("x") + F.col("w")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    parts = lined.withColumn("new", F.coalesce((F.col("x") > reach + gap).cast("int"), F.lit(0))).withColumn("part", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parts.groupBy("mark_id", "line", "part").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count(F.lit(1)).alias("n"))


def ratios(rect: Column, width: Column, height: Column) -> Column:
    """A rectangle (x, y, w, h) in page units as shares of the page."""
    return F.struct((rect["x"] / width).alias("left_ratio"), (rect["y"] / height).alias("top_ratio"), (rect["w"] / width).alias("width_ratio"), (rect["h"] / height).alias("height_ratio"))


def commented(marks: DataFrame, comments: DataFrame, width: float, height: float) -> DataFrame:
    """``doc_id, comment_id, mark_id``: a comment belongs to the mark it names; another to the nearest mark of its page
    without a comment, nearer than a tenth of the page's longer side. Comments choose in the order of their ids, and a
    mark takes one comment.

    Comments meet the marks within reach in cells of that size. In a round each comment looks at its nearest mark that is left, and has it
    if no earlier comment that is undecided could still want it; so each page's first comment is always settled, and most others with it.
    """
    named = comments.join(marks.select("doc_id", F.col("mark_id").alias("linked")), ["doc_id", "linked"], "left_semi").select("doc_id", "comment_id", F.col("linked").alias("mark_id"))
    taken = named.select("doc_id", "mark_id").distinct()
    free = marks.join(taken, ["doc_id", "mark_id"], "left_anti")
    asking = comments.join(named.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti")
    most = NEAR * max(width, height)
    cell = lambda c, by: F.floor((F.col(c) + by) / most)
    over = lambda c: F.explode(F.sequence(cell(c, -most), cell(c, most)))
    near = asking.select("doc_id", "page_no", "comment_id", F.col("x").alias("cx"), F.col("y").alias("cy")).withColumn("i", over("cx")).withColumn("j", over("cy"))
    near = near.join(free.select("doc_id", "page_no", "mark_id", "x", "y", cell("x", 0.0).alias("i"), cell("y", 0.0).alias("j")), ["doc_id", "page_no", "i", "j"])
    off = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    pairs = cut(near.select("doc_id", "page_no", "comment_id", "mark_id", off.alias("off")).where(F.col("off") < most * most))
    found = named
    while not pairs.isEmpty():
        wanted = pairs.groupBy("doc_id", "page_no", "comment_id").agg(F.min(F.struct("off", "mark_id"))["mark_id"].alias("mark_id"))
        first = pairs.groupBy("doc_id", "mark_id").agg(F.min("comment_id").alias("comment_id"))
        settled = cut(wanted.join(first, ["doc_id", "mark_id", "comment_id"], "left_semi"))
        found = found.unionByName(settled.select("doc_id", "comment_id", "mark_id"))
        pairs = cut(pairs.join(settled.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti").join(settled.select("doc_id", "mark_id"), ["doc_id", "mark_id"], "left_anti"))
    return found


def color_dots(marks: DataFrame, most: int = 3) -> DataFrame:
    """``section_id, colors, extra``: the first three distinct colours of a section's marks, and how many marks go beyond three."""
    first = marks.groupBy("section_id", "color").agg(F.min("mark_id").alias("first"), F.count(F.lit(1)).alias("n"))
    listed = first.withColumn("nth", F.row_number().over(Window.partitionBy("section_id").orderBy("first")))
    colors = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("first", "color"))))
    return listed.groupBy("section_id").agg(F.array_join(F.transform(colors, lambda s: s["color"]), ",").alias("colors"), F.greatest(F.sum("n") - most, F.lit(0)).alias("extra"))
