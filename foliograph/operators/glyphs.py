"""From glyphs to lines: characters into runs, runs into items and lines, and where the header and footer are.

Characters are ``doc_id, page_no, idx, code, left, bottom, right, top, font_size, font_family``; a character without a box has
null edges. y grows upwards; ``original_y`` counts from the page's top.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliograph.functions.folds import in_order
from foliograph.functions.stats import mode_first_seen
from foliograph.operators.layout import PAGE_HEIGHT, PAGE_WIDTH, on_lines

#: parts of family names that tell a style (fixed values); the last of the bold ones in that very case
BOLD_NAMES = ("bold", "black", "heavy", "semibold", "-bd", "-medi", "cmbx")
BOLD_EXACT = "SFSX"
#: texts that Python composes at a time
TEXTS_AT_ONCE = 64
ITALIC_NAMES = ("italic", "ital", "oblique", "slant", "-it")
#: blocks of characters without blanks between words (fixed values)
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF00, 0xFFEF), (0xAC00, 0xD7AF))
#: limits of a box, and of a run (fixed values)
TALLEST, WIDEST = 100.0, 200.0


def is_cjk(code: Column) -> Column:
    """Whether a code point is of a script without blanks between words."""
    out = F.lit(False)
    for first, last in CJK:
        out = out | code.between(first, last)
    return out


def font_style(family: Column) -> Column:
    """0 regular, 1 bold, 2 italic, 3 both, by parts of the family's name; null is regular."""
    low = F.lower(family)
    any_of = lambda names: F.greatest(*(F.contains(low, F.lit(n)) for n in names))
    bold = F.coalesce(any_of(BOLD_NAMES) | F.contains(family, F.lit(BOLD_EXACT)), F.lit(False))
    return bold.cast("int") + 2 * F.coalesce(any_of(ITALIC_NAMES), F.lit(False)).cast("int")


def seen(chars: DataFrame) -> DataFrame:
    """Characters with what runs are told by: ``kind`` (0 newline, 1 blank or without a box, 2 digit, 3 letter, 4 one of , . ; :, 5
    other) and ``cjk``. Boxes turned inside out and too large ones are left out."""
    code, width, height = F.col("code"), F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    letter = code.between(65, 90) | code.between(97, 122) | (code > 127)
    blank = code.isin(9, 11, 12, 32, 160, 0xFEFF) | code.between(0x2000, 0x200A) | (code < 32) | code.between(127, 159)
    kind = F.when(code.isin(10, 13), 0).when(blank | F.col("left").isNull(), 1).when(code.between(48, 57), 2).when(letter, 3).when(code.isin(44, 46, 58, 59), 4).otherwise(5)
    marked = chars.withColumns({"kind": kind, "cjk": is_cjk(code), "height": height})
    odd = (F.col("kind") > 1) & (((width < 0) & (height < 0)) | (height > TALLEST) | (width > WIDEST))
    return marked.where(~odd)


class _Run:
    """A run of characters in the making."""

    def __init__(self) -> None:
        self.no, self.row, self.text, self.tail = -1, None, "", ""

    def breaks(self, c: dict) -> bool:
        r = self.row
        if r is None or self.tail or c["cjk"] or r["cjk"]:
            return True
        if abs(c["bottom"] - r["bottom"]) >= 1.2 * r["tall"] or c["left"] - r["right"] >= 2 * r["tall"]:
            return True
        return 2 in (c["kind"], r["kind"]) and c["kind"] + r["kind"] in (5, 6) and c["kind"] != r["kind"]

    def ended(self) -> list[tuple]:
        r, text = self.row, self.text + self.tail
        self.row, self.text, self.tail = None, "", ""
        if r is None or not text.strip() or r["tall"] > TALLEST:
            return []
        self.no += 1
        return [(r["doc_id"], r["page_no"], self.no, text, r["left"], r["top"], r["right"] - r["left"], r["tall"], r["font_size"] or r["tall"], r["font_family"])]

    def takes(self, c: dict) -> list[tuple]:
        letter = chr(c["code"])
        if c["kind"] < 2:
            if self.row is None:
                return []
            self.tail += letter
            return self.ended() if c["kind"] == 0 else []
        out = []
        if self.breaks(c):
            out = self.ended()
            self.row = c | {"tall": c["height"]}
        else:
            r = self.row
            r["right"], r["bottom"], r["top"] = max(r["right"], c["right"]), min(r["bottom"], c["bottom"]), max(r["top"], c["top"])
            r["tall"] = max(r["tall"], c["height"]) if c["height"] > 5 else r["tall"]
            r["kind"], r["cjk"] = c["kind"], c["cjk"]
        self.text += letter
        return out


def runs(chars: DataFrame) -> DataFrame:
    """``doc_id, page_no, slice_no, content, x, y, w, h, font_size, font_family``: characters of a page in order as runs. A run ends
    behind blanks, at another line, a wide gap, between digits and letters or punctuation, and around characters of scripts
    without blanks. Its y is its top, its height the largest box's."""
    schema = "doc_id long, page_no int, slice_no int, content string, x double, y double, w double, h double, font_size double, font_family string"
    return in_order(seen(chars), ["doc_id", "page_no"], ["idx"], schema, _Run, _Run.takes, _Run.ended, light=True)


def items(slices: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Runs with something in them as items: ``original_y`` is the distance from the page's top, ``style`` the font's."""
    kept = slices.where(F.col("content").rlike(r"(?U)\S"))
    return kept.withColumns({"original_y": F.lit(page_height) - F.col("y") + 1, "style": font_style(F.col("font_family"))})


def lines_of(slices: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Items as lines, in stream order: ``text``, the first item's ``x`` and ``y``, upper medians of ``original_y``, ``h`` (of heights
    above 2) and ``font_size``, ``w`` to the last item's right edge, and the ``style`` that any item has."""
    told = on_lines(items(slices, page_height), "slice_no")
    item = F.struct("slice_no", "content", "x", "y", "w", "original_y", "h", "font_size")
    out = told.groupBy("doc_id", "page_no", F.col("line").alias("line_no")).agg(F.array_sort(F.collect_list(item)).alias("i"), F.bit_or("style").alias("style"))
    falling = lambda c: F.sort_array(F.filter(F.transform("i", lambda s: s[c]), lambda v: v > 2 if c == "h" else v.isNotNull()), asc=False)
    middle = lambda c: F.get(falling(c), F.ceil(F.size(falling(c)) / 2).cast("int") - 1).alias(c)
    first, end = F.element_at("i", 1), F.element_at("i", -1)
    return out.select("doc_id", "page_no", "line_no", F.array_join(F.transform("i", lambda s: s["content"]), "").alias("text"), first["x"].alias("x"), first["y"].alias("y"), middle("original_y"), (end["x"] + end["w"] - first["x"]).alias("w"), middle("h"), middle("font_size"), "style")


def composed(text: Column | str) -> Column:
    """Text with its characters composed (NFC). Only texts with other characters than those of ASCII leave the JVM, and few are Python's at a time."""
    whole = F.col(text) if isinstance(text, str) else text
    return F.coalesce(normalized(F.when(F.octet_length(whole) > F.length(whole), whole)), whole)


@F.arrow_udf(StringType())
def normalized(text: pa.Array) -> pa.Array:
    made = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.slice(lo, TEXTS_AT_ONCE).to_pylist()], pa.string()) for lo in range(0, len(text), TEXTS_AT_ONCE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def letter(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def page_texts(chars: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_text``: all characters of a page in order, composed."""
    listed = F.array_sort(F.collect_list(F.struct("idx", letter(F.col("code")).alias("c"))))
    return chars.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(listed, lambda s: s["c"]), "").alias("t")).select("doc_id", "page_no", composed("t").alias("page_text"))


def char_range_rects(chars: DataFrame, ranges: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """The rectangles of ranges of characters (``doc_id, page_no, range_no, begin, length``): one a line, of the characters with a
    box; y counts from the page's top. A line ends where the next character's bottom is half its height away."""
    boxed = chars.where(F.col("left").isNotNull())
    inside = ranges.join(boxed, ["doc_id", "page_no"]).where((F.col("idx") >= F.col("begin")) & (F.col("idx") < F.col("begin") + F.col("length")))
    order = Window.partitionBy("doc_id", "page_no", "range_no").orderBy("idx")
    new = F.coalesce(F.abs(F.col("bottom") - F.lag("bottom").over(order)) > 0.5 * (F.col("top") - F.col("bottom")), F.lit(False)).cast("int")
    rows = inside.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    box = rows.groupBy("doc_id", "page_no", "range_no", "part").agg(F.min("left").alias("l"), F.max("right").alias("r"), F.min("bottom").alias("b"), F.max("top").alias("t"))
    return box.select("doc_id", "page_no", "range_no", F.col("part").cast("int").alias("part"), F.col("l").alias("x"), (F.lit(page_height) - F.col("t")).alias("y"), (F.col("r") - F.col("l")).alias("w"), (F.col("t") - F.col("b")).alias("h"))


def without_soft_hyphens(texts: DataFrame, column: str = "text") -> DataFrame:
    """``text`` without continuation hyphens (U+FFFE, a line feed behind it included) as ``clean``, and ``gaps``: where in the clean text
    something is missing, and how much."""
    gaps = F.split(column, "￾\n?", -1)
    hits = F.regexp_extract_all(F.col(column), F.lit("￾\n?"), F.lit(0))
    sizes = F.transform(hits, lambda h: F.length(h))
    # a clean text's places: one pass over the lengths, each place the one before and the piece between
    start = F.array().cast("array<int>")
    places = F.aggregate(F.slice(gaps, F.lit(1), F.size(hits)), start, lambda out, g: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + F.length(g))))
    return texts.withColumns({"clean": F.array_join(gaps, ""), "gaps": F.arrays_zip(places.alias("at"), sizes.alias("size"))})


def original_place(clean: Column, gaps: Column) -> Column:
    """The place in the original text of a place in the clean one: what is missing at or before it is added."""
    return F.aggregate(gaps, clean, lambda p, g: F.when(g["at"] <= clean, p + g["size"]).otherwise(p))


def separators(paths: DataFrame, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """``doc_id, page_no, header_sep_y, footer_sep_y``: upper medians of the thin wide rules in the outer 0.15 of a page; null if none.
    ``paths`` are ``doc_id, page_no, left, bottom, right, top``."""
    rule = (F.col("top") - F.col("bottom") < 3) & (F.col("right") - F.col("left") > 0.6 * page_width)
    upper, lower = F.col("bottom") > 0.85 * page_height, F.col("top") < 0.15 * page_height
    rules = paths.withColumns({"up": F.when(rule & upper, F.col("bottom")), "down": F.when(rule & lower, F.col("top"))})
    middle = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    return rules.groupBy("doc_id", "page_no").agg(middle("up").alias("header_sep_y"), middle("down").alias("footer_sep_y"))


def banded(lines: DataFrame, seps: DataFrame | None = None, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Lines with ``band``: ``header`` or ``footer`` for short lines (120 characters and 0.7 of the page at most) beyond the page's
    separator, or beyond nine tenths and one tenth of its height where it has none; else null."""
    rows = lines.join(seps, ["doc_id", "page_no"], "left") if seps is not None else lines.withColumns({"header_sep_y": F.lit(None).cast("double"), "footer_sep_y": F.lit(None).cast("double")})
    short = (F.length(F.trim("text")) <= 120) & (F.col("w") <= 0.7 * page_width)
    above, below = F.col("y") > F.coalesce("header_sep_y", F.lit(0.9 * page_height)), F.col("y") < F.coalesce("footer_sep_y", F.lit(0.1 * page_height))
    return rows.withColumn("band", F.when(short & above, "header").when(short & ~above & below, "footer")).drop("header_sep_y", "footer_sep_y")


def band_heights(seps: DataFrame, page_height: float = PAGE_HEIGHT, most: int = 10) -> DataFrame:
    """``doc_id, header_height, footer_height``: the commonest extents (the first among equals) over a document's first ten pages
    from page 2 on; 0 where fewer than two pages have a separator."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    some = seps.where("page_no <> 1").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    kinds = F.array(F.struct(F.lit("header_height").alias("k"), (F.lit(page_height) - F.col("header_sep_y")).alias("v")), F.struct(F.lit("footer_height").alias("k"), F.col("footer_sep_y").alias("v")))
    each = some.select("doc_id", "page_no", F.explode(kinds).alias("s")).select("doc_id", "page_no", "s.k", "s.v").where("v is not null")
    enough = each.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    modes = mode_first_seen(each.join(enough, ["doc_id", "k"], "left_semi"), ["doc_id", "k"], "v", ["page_no"], "v")
    of = lambda name: F.coalesce(F.max(F.when(F.col("k") == name, F.col("v"))), F.lit(0.0)).alias(name)
    return seps.select("doc_id").distinct().join(modes.groupBy("doc_id").agg(of("header_height"), of("footer_height")), "doc_id", "left").select("doc_id", F.coalesce("header_height", F.lit(0.0)).alias("header_height"), F.coalesce("footer_height", F.lit(0.0)).alias("footer_height"))


def line_like_paths(paths: DataFrame) -> DataFrame:
    """Of drawn objects those that may be rules: paths of two segments, a move and a line, and images that look like a line
    (thinner than 3 and longer than 20). ``paths`` has ``kind`` (path, image), ``moves`` and ``segments`` besides its edges."""
    width, height = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    stroke = (F.col("kind") == "path") & (F.col("segments") == 2) & (F.col("moves") == 1)
    thin = ((height < 3) & (width > 20)) | ((width < 3) & (height > 20))
    return paths.where(stroke | ((F.col("kind") == "image") & thin))
