"""Joins by place: overlapping rectangles, the nearest target, and the containing section.

Document and page are equality keys of every join. What a page of up to ``FEW`` targets holds is one list, which comes to each row of the other side
once; on fuller pages the cells of a grid are keys too: what meets is near, and no such page's rows all meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.folds import PART, by_size, cut, laid_out, so_far

PAGE = ["doc_id", "page_no"]
#: targets of a page that are listed as a whole
FEW = 64
#: width and height of the cells in which rectangles meet, and columns and rows of cells; what lies beyond is in the outermost
WIDE, HIGH, COLUMNS, ROWS = 96.0, 32.0, 16, 64
#: how far the search for the nearest target goes at first, and how much farther when that proves nothing
REACH, FARTHER = 12.0, 4


def overlaps(a: Column, b: Column, tolerance: float) -> Column:
    """Whether rectangles (x, y, w, h) overlap with ``tolerance`` units to spare; below 0 they must overlap by more."""
    t = F.lit(tolerance)
    return (a["x"] < b["x"] + b["w"] + t) & (a["x"] + a["w"] + t > b["x"]) & (a["y"] < b["y"] + b["h"] + t) & (a["y"] + a["h"] + t > b["y"])


def cell(value: Column, size: float, most: int) -> Column:
    return F.least(F.greatest(F.floor(value / size), F.lit(-1).cast("long")), F.lit(most).cast("long"))


def by_page(targets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, page_no, __there``: the targets of each page of up to ``FEW`` as a list of structs; and the targets of fuller pages, None if there are none."""
    rows = cut(targets)
    full = cut(rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(*PAGE))
    listed = lambda some: some.groupBy(*PAGE).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in PAGE))).alias("__there"))
    if full.isEmpty():
        return listed(rows), None
    return listed(rows.join(full, PAGE, "left_anti")), rows.join(full, PAGE, "left_semi")


def with_list(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows``, each with ``__there``, the targets of its page as a list of structs; of a page of more than ``FEW`` there are ``FEW`` + 1 in it.

    Both sides lie page by page, targets first: nothing is counted or listed beforehand, and what is dealt by document already, as rows numbered
    within documents are, isn't shuffled again.
    """
    kinds = {c: rows.schema[c].dataType for c in PAGE}
    of = lambda side: side.dropna(subset=PAGE).select(*PAGE, F.struct(*(c for c in side.columns if c not in PAGE)).alias("__of"))
    both = of(targets).withColumnRenamed("__of", "__t").unionByName(of(rows), allowMissingColumns=True)
    page = Window.partitionBy(*PAGE)
    nth = F.row_number().over(page.orderBy(F.col("__t").isNull()))
    some = F.collect_list(F.when(F.col("__nth") <= FEW + 1, F.col("__t"))).over(page)
    listed = both.withColumn("__nth", nth).withColumn("__there", some).where("__of IS NOT NULL")
    return listed.select(*(F.col(c).cast(kinds[c]).alias(c) for c in PAGE), "__of.*", "__there").select(*rows.columns, "__there")


def meeting(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Rows of ``left`` (a rectangle ``a`` and others) and ``right`` (``b`` and others) of one page whose rectangles overlap, as ``overlaps``.

    Each of ``left`` goes through the list of its page, and those that meet something are written with it; on full pages rectangles meet in cells. Null
    rectangles meet nothing.
    """
    there = right.where("b IS NOT NULL")
    full = F.size("__there") > FEW
    hits = F.when(~full, F.filter("__there", lambda t: overlaps(F.col("a"), t["b"], tolerance)))
    both = with_list(left.where("a IS NOT NULL"), there).select(*left.columns, hits.alias("__hits"), full.alias("__full"))
    seen = cut(both.where(F.col("__full") | (F.size("__hits") > 0)))
    found = seen.where("NOT __full").select(*left.columns, F.explode("__hits").alias("__t"))
    met = found.select(*left.columns, *(F.col("__t")[c].alias(c) for c in there.columns if c not in PAGE))
    fuller = seen.where("__full").select(*left.columns)
    if fuller.isEmpty():
        return met
    return met.unionByName(meeting_in_cells(fuller, there.join(fuller.select(*PAGE).distinct(), PAGE, "left_semi"), tolerance))


def meeting_in_cells(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """``meeting`` for full pages: rectangles are dealt to the cells that they touch and meet within a cell. Of the cells that two share the one counts that
    holds the larger of their left and of their lower edges."""
    grown = max(tolerance, 0.0)

    def dealt(rows: DataFrame, name: str, by: float) -> DataFrame:
        low = lambda c, s: F.least(F.col(f"{name}.{c}"), F.col(f"{name}.{c}") + F.col(f"{name}.{s}")) - by
        high = lambda c, s: F.greatest(F.col(f"{name}.{c}"), F.col(f"{name}.{c}") + F.col(f"{name}.{s}")) + by
        over = lambda c, s, size, most: F.explode(F.sequence(cell(low(c, s), size, most), cell(high(c, s), size, most)))
        return rows.where(F.col(name).isNotNull()).withColumn("__cx", over("x", "w", WIDE, COLUMNS)).withColumn("__cy", over("y", "h", HIGH, ROWS))

    both = dealt(left, "a", grown).join(dealt(right, "b", 0.0), [*PAGE, "__cx", "__cy"])
    edge = lambda c, s: F.greatest(F.least(F.col(f"a.{c}"), F.col(f"a.{c}") + F.col(f"a.{s}")) - grown, F.least(F.col(f"b.{c}"), F.col(f"b.{c}") + F.col(f"b.{s}")))
    here = (cell(edge("x", "w"), WIDE, COLUMNS) == F.col("__cx")) & (cell(edge("y", "h"), HIGH, ROWS) == F.col("__cy"))
    return both.where(overlaps(F.col("a"), F.col("b"), tolerance) & here).drop("__cx", "__cy")


def first_overlap(links: DataFrame, cited: DataFrame, tolerance: float = -5.0) -> DataFrame:
    """Each link (``doc_id, page_no, link_no, rect``) with the first citation (``cit_no, rect``) of its page that it overlaps; null if none.
    Equal rectangles of a page are one when they meet."""
    places = lambda rows: rows.groupBy(*PAGE, "rect")
    met = meeting(links.select(*PAGE, "rect").distinct().withColumnRenamed("rect", "a"), places(cited).agg(F.min("cit_no").alias("cit_no")).withColumnRenamed("rect", "b"), tolerance)
    first = met.groupBy(*PAGE, F.col("a").alias("rect")).agg(F.min("cit_no").alias("cit_no"))
    return links.select(*PAGE, "link_no", "rect").join(first, [*PAGE, "rect"], "left").drop("rect")


def nearest(points: DataFrame, targets: DataFrame, measure, proven, most: float | None = None, allowed=None) -> DataFrame:
    """Each point's (``doc_id, page_no, point_no, x, y``) nearest target (``target_no, left, right, low, high``) of its page, the smallest of
    equally near ones: ``doc_id, page_no, point_no, far, target_no``; points on pages without one are left out.

    ``measure(dx, dy)`` is the distance by how far a point is off a target sideways and up or down, ``proven(reach)`` the distance up to which any
    target lies within ``reach`` both ways. With ``most`` only targets proven by that reach count. ``allowed(of)`` is a condition on both, ``of`` naming
    a target's columns and a point's ``x`` and ``y``.
    """
    targets = targets.select(*PAGE, "target_no", *EDGES).dropna(subset=EDGES)
    found, full = nearest_listed(points, targets, measure, allowed)
    found = found if most is None else found.where(F.col("far") <= proven(most))
    return found if full is None else found.unionByName(nearest_in_cells(points, targets.join(full, PAGE, "left_semi"), measure, proven, most, allowed))


#: what of a target is measured
EDGES = ["left", "right", "low", "high"]


def nearest_listed(points: DataFrame, targets: DataFrame, measure, allowed=None) -> tuple[DataFrame, DataFrame | None]:
    """``nearest`` on pages of up to ``FEW`` targets: each point goes through its page's list. And the fuller pages that points are on, None if there are none.
    What was found is written, a row a point; points and targets themselves aren't."""
    keys = [*PAGE, "point_no"]
    off = lambda low, at, high: F.greatest(low - at, at - high, F.lit(0.0))
    told = lambda t: F.struct(measure(off(t["left"], F.col("x"), t["right"]), off(t["low"], F.col("y"), t["high"])).alias("far"), t["target_no"].alias("target_no"))
    there = F.col("__there") if allowed is None else F.filter("__there", lambda t: allowed(lambda c: F.col(c) if c in ("x", "y") else t[c]))
    full = F.size("__there") > FEW
    both = with_list(points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y"), targets)
    seen = both.select(*keys, F.when(~full, F.array_min(F.transform(there, told))).alias("m"), full.alias("full")).where("m IS NOT NULL OR full")
    seen = cut(seen.groupBy(*keys).agg(F.min("m").alias("m"), F.max("full").alias("full")))
    found, fuller = seen.where("NOT full").select(*keys, "m.far", "m.target_no"), seen.where("full")
    return found, None if fuller.isEmpty() else fuller.select(*PAGE).distinct()


def nearest_in_cells(points: DataFrame, targets: DataFrame, measure, proven, most: float | None = None, allowed=None) -> DataFrame:
    """``nearest`` for full pages. Points look at the cells, twice as large as the reach, that their reach touches; those that find none so near that a
    nearer one would have been seen look ``FARTHER`` times as far, until none is left. With ``most`` they look that far, once."""
    keys = [*PAGE, "point_no"]
    targets = cut(targets)
    asked = points.select(*keys, "x", "y").join(targets.select(*PAGE).distinct(), PAGE, "left_semi")

    def look(left: DataFrame, reach: float) -> DataFrame:
        over = lambda low, high: F.explode(F.sequence(F.floor(low / (2 * reach)), F.floor(high / (2 * reach))))
        seen = left.withColumn("__cx", over(F.col("x") - reach, F.col("x") + reach)).withColumn("__cy", over(F.col("y") - reach, F.col("y") + reach))
        there = targets.select(*PAGE, "target_no", *EDGES).withColumn("__cx", over(F.col("left"), F.col("right"))).withColumn("__cy", over(F.col("low"), F.col("high")))
        both = seen.join(there, [*PAGE, "__cx", "__cy"])
        both = both.where(allowed(F.col)) if allowed is not None else both
        off = lambda low, at, high: F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))
        best = both.groupBy(*keys).agg(F.min(F.struct(measure(off("left", "x", "right"), off("low", "y", "high")).alias("far"), "target_no")).alias("m"))
        return best.select(*keys, "m.far", "m.target_no").where(F.col("far") <= proven(reach))

    if most is not None:
        return look(asked, most)
    left, reach, found = asked, REACH, None
    while True:
        done = cut(look(left, reach))
        found = done if found is None else found.unionByName(done)
        left = cut(left.where("x IS NOT NULL AND y IS NOT NULL").join(done.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            return found
        reach *= FARTHER


def across(dx: Column, dy: Column) -> Column:
    return dx + dy


def as_points(rows: DataFrame, number: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows that are places as targets of ``nearest``."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*PAGE, F.col(number).alias("target_no"), F.col(x).alias("left"), F.col(x).alias("right"), F.col(y).alias("low"), F.col(y).alias("high"))


def beside(points: DataFrame, targets: DataFrame, above: bool = True) -> DataFrame:
    """Points (``doc_id, page_no, point_no, y``) with ``below`` and ``above``, the last target (``target_no, y``) of the page at or below a point and the
    next one above it, as structs of ``y`` and the smallest number there; null if there is none. Without ``above`` only the first is sought. Both sides in one order, and the last
    target seen from either side: no pairs."""
    seen = F.when(F.col("kind") == 0, F.struct("y", "target_no"))
    order = ["y", "kind", "point_no"]
    places = targets.where("y IS NOT NULL").groupBy(*PAGE, "y").agg(F.min("target_no").alias("target_no"))
    marks = places.select(*PAGE, "y", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point_no"), "target_no")
    asked = points.where("y IS NOT NULL").select(*PAGE, "y", F.lit(1).alias("kind"), F.col("point_no").cast("long").alias("point_no"), F.lit(None).cast(places.schema["target_no"].dataType).alias("target_no"))
    few, many = by_size(cut(marks.unionByName(asked)), PAGE)
    before = lambda *by: F.last(seen, ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    sides = {"below": before(*order)} | ({"above": before(*map(F.desc, order))} if above else {})
    found = few.withColumns(sides)
    if many is not None:
        dealt = so_far(laid_out(many, PAGE, order), PAGE, order, last={"below": seen}).drop(PART)
        if above:
            dealt = so_far(laid_out(dealt, PAGE, order, falling=True), PAGE, order, last={"above": seen}, falling=True).drop(PART)
        found = found.unionByName(dealt)
    return found.where("kind = 1").select(*PAGE, "point_no", "y", *sides)


def nearest_below(points: DataFrame, anchors: DataFrame, most: float) -> DataFrame:
    """``doc_id, page_no, point_no, far, target_no`` of each point's nearest anchor (``target_no, x, y``) at or below it by |dx| + |dy|, nearer than
    ``most``; where a point's x is 0, dx counts nothing and the last anchor in y is the nearest."""
    x = F.coalesce(F.col("x").cast("double"), F.lit(float("nan")))  # without an x an anchor is near to points at 0 alone
    targets = anchors.where("y IS NOT NULL").select(*PAGE, "target_no", x.alias("left"), x.alias("right"), F.col("y").alias("low"), F.col("y").alias("high"))
    below = lambda of: of("low") <= of("y")
    found, full = nearest_listed(points, targets, lambda dx, dy: F.when(F.col("x") == 0, dy).otherwise(across(dx, dy)), below)
    if full is not None:
        crowd = cut(targets.join(full, PAGE, "left_semi"))
        asked = points.join(crowd.select(*PAGE).distinct(), PAGE, "left_semi")
        aside = nearest_in_cells(asked.where("x <> 0"), crowd.where(~F.isnan("left")), across, F.lit, most, below)
        straight = beside(asked.where("x = 0"), crowd.select(*PAGE, "target_no", F.col("low").alias("y")), above=False).where("below is not null").select(*PAGE, "point_no", (F.col("y") - F.col("below.y")).alias("far"), F.col("below.target_no").alias("target_no"))
        found = found.unionByName(aside).unionByName(straight)
    return found.where(F.col("far") < most)


def nearest_anchor(points: DataFrame, anchors: DataFrame, most: float = 50.0) -> DataFrame:
    """Each point's nearest anchor of its page at or below it, by |dx| + |dy| (dx counts nothing for x = 0), nearer than ``most``."""
    near = nearest_below(points, anchors.withColumnRenamed("anchor_no", "target_no"), most)
    return near.select(*PAGE, "point_no", F.col("target_no").alias("anchor_no"), F.round("far", 6).alias("distance"))


def containing_section(points: DataFrame, sections: DataFrame) -> DataFrame:
    """Each point's section: the last one that doesn't come after it in reading order, pages first, then from the top down.
    A union of both sides in that order, and the last section seen: one sort, no pairs."""
    marks = sections.select("doc_id", "page_no", (-F.col("y")).alias("down"), F.lit(0).alias("kind"), F.col("section_no").alias("section"), F.lit(None).cast("long").alias("point_no"))
    asked = points.select("doc_id", "page_no", (-F.col("y")).alias("down"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("section"), F.col("point_no").cast("long").alias("point_no"))
    order = Window.partitionBy("doc_id").orderBy("page_no", "down", "kind", "section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.unionByName(asked).withColumn("section_no", F.last("section", ignorenulls=True).over(order)).where("kind = 1").select("doc_id", "point_no", "section_no")


def containing_section_by_columns(points: DataFrame, sections: DataFrame) -> DataFrame:
    """As ``containing_section``, on pages with columns: both sides have a ``column`` (-1 for the whole width), and the order is that of
    ``outline.reading_order``: pages, bands between things over the whole width, columns, then from the top down."""
    from foliograph.operators.outline import reading_order

    none = F.lit(None).cast("long")
    marks = sections.select("doc_id", "page_no", "x", "y", "column", F.lit(0).alias("ord"), F.col("section_no").cast("long").alias("section"), none.alias("point_no"))
    asked = points.select("doc_id", "page_no", "x", "y", "column", F.lit(1).alias("ord"), none.alias("section"), F.col("point_no").cast("long").alias("point_no"))
    placed = reading_order(marks.unionByName(asked))
    order = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("section_no", F.last("section", ignorenulls=True).over(order)).where("ord = 1").select("doc_id", "point_no", "section_no")


def best_by_place(rows: DataFrame) -> DataFrame:
    """Of rows at one rounded place the one of the highest confidence, the earliest among equals."""
    rx, ry = (F.floor(F.col(c) + 0.5).cast("long") for c in ("x", "y"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "ord"))
    return rows.groupBy("doc_id", "page_no", rx.alias("rx"), ry.alias("ry")).agg(best.alias("b")).select("doc_id", "page_no", "rx", "ry", F.col("b.ord").alias("ord"), (-F.col("b.c")).alias("confidence"))


def bounding_boxes(rects: DataFrame, keys: list[str]) -> DataFrame:
    x, y, w, h = (F.col(f"rect.{c}") for c in "xywh")
    return rects.groupBy(*keys).agg(F.min(x).alias("left"), F.min(y).alias("top"), F.max(x + w).alias("right"), F.max(y + h).alias("bottom"))


def merged_rects(rects: DataFrame, gap: float = 8.0) -> DataFrame:
    """Rectangles of a line (``doc_id, page_no, line_no, x, w``) joined where no more than ``gap`` apart."""
    order = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("x", "w")
    reach = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = rects.withColumn("new", F.coalesce((F.col("x") > reach + gap).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("doc_id", "page_no", "line_no", "island").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.count(F.lit(1)).alias("n"))
