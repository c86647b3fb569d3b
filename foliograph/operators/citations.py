"""Inline citations, cross references and reference lists, and the joins between them.

Texts are ``doc_id, body``; reference lists are ``doc_id, ref_ord, ref_index, text, year``. Places are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import patterns, scanner
from foliograph.functions.folds import cut
from foliograph.functions.text import expand_numbers, number_items

LEAST_CONFIDENCE = 0.3
#: what a citation says about itself, as bits (fixed values)
NATIVE, DESTINATION, RANGE, MULTI_REF, MULTI_YEAR = 1, 2, 4, 8, 16
#: formats of numbered reference lists, in order of preference, and what else a list may be (fixed values)
NUMBERED = ("numbered-bracket", "numbered-paren", "numbered-dot", "numbered-plain", "numbered-abbr")
AUTHOR_YEAR, HANGING, UNKNOWN = "author-year", "hanging-indent", "unknown"
#: what a confidence is multiplied by where the reference list is of another kind
PENALTY = 0.6


def citations(bodies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Numeric citations of every text: ranges between brackets first, then brackets, then abbreviated keys; a match that
    overlaps an earlier kind's is dropped. ``content`` is what stands in the brackets, as ``a-b`` for a range between them."""
    keys = keys or ["doc_id"]
    return bodies.select(*keys, F.inline(patterns.bracket_citations(F.col("body"))))


def cited_numbers(found: DataFrame) -> DataFrame:
    """One row for each number that a numeric citation stands for, ranges expanded."""
    return found.where("kind <> 'abbreviated'").select("doc_id", "begin", F.posexplode(expand_numbers(F.col("content"))).alias("place", "number"))


def first_entries(refs: DataFrame) -> DataFrame:
    """Of entries with one index the first; its place in the list is ``ref_ord``."""
    return refs.groupBy("doc_id", "ref_index").agg(F.min("ref_ord").alias("ref_ord"))


def linked(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Numeric citations with at least one number in the reference list: their numbers, how many are valid, the first
    entry's place, and the confidence, valid over all."""
    numbers = cited_numbers(found).join(first_entries(refs).withColumnRenamed("ref_index", "number"), ["doc_id", "number"], "left")
    out = numbers.groupBy("doc_id", "begin").agg(F.count(F.lit(1)).alias("total"), F.count("ref_ord").alias("valid"), F.min("ref_ord").alias("first_ref"))
    return out.where("valid > 0").withColumn("confidence", F.round(F.col("valid") / F.col("total"), 6)).where(F.col("confidence") >= LEAST_CONFIDENCE)


def author_years(bodies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Author-year citations by every rule, overlaps included: one row for each year, letters expanded. ``rank`` is the
    rule's, blocks first, and ``at`` to ``end`` the text it takes up: the whole block for each of its citations, which
    begin where their first author does. ``second`` is the second author where the reference must have one."""
    keys = keys or ["doc_id"]
    found = scanner.read_by(bodies, keys, "body", scanner.author_citations, "rank int, at int, end int, begin int, author string, second string, year string")
    return found.select(*keys, "begin", "rank", "at", "end", "author", "second", "year")


def signature(text: Column) -> Column:
    """The first 40 characters of an entry without its number, lower case: where authors are sought."""
    return F.lower(F.left(F.regexp_replace(text, r"^\s*(?:\[[^\]]*\]|\([0-9]+\)|[0-9]+\.)\s*", ""), F.lit(40)))


def matched_authors(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """Author-year citations with an entry of the same year: the author at its start (confidence 1), anywhere as a word
    (0.7), or the only entry of that year (0.5); the first entry among equals. A second author, where ``cited`` has one, must
    be a word of the entry too, but for the last. An equi-join on document and year."""
    of_year = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "year"))  # by the shuffle of the join
    entries = refs.select("doc_id", "year", "ref_ord", signature(F.col("text")).alias("signature")).withColumn("of_year", of_year)
    both = cited.join(entries, ["doc_id", "year"])
    # the name's places become a sign that no text has, so that one constant pattern serves all names
    marked = lambda name: F.replace(F.concat(F.lit(" "), F.col("signature"), F.lit(" ")), F.lower(F.trim(name)), F.lit("\1"))
    word = lambda name: F.rlike(marked(name), F.lit("(?<![A-Za-z0-9_])\1(?![A-Za-z0-9_])"))
    starts = F.rlike(marked("author"), F.lit("^ \1(?!\\p{L})"))
    joint = F.col("second").isNull() | word("second") if "second" in cited.columns else F.lit(True)
    sure = F.when(starts & joint, 1.0).when(word("author") & joint, 0.7).when(F.col("of_year") == 1, 0.5)
    ranked = both.where(F.length(F.trim("author")) >= 2).withColumn("confidence", sure).where("confidence is not null")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "ref_ord"))
    return ranked.groupBy(*cited.columns).agg(best.alias("b")).select(*cited.columns, F.col("b.ref_ord").alias("ref_ord"), (-F.col("b.c")).alias("confidence"))


def claimed(matched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matched citations (``rank, at, end, begin`` and more) that no earlier rule's match overlaps; a citation without an
    entry claims no text. The citations of one text are settled together."""
    keys = keys or ["doc_id"]
    first = ["rank", "at", "end", "begin"]
    columns = [*first, *(c for c in matched.columns if c not in (*first, *keys))]
    rows = matched.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("every"))
    taken = lambda out, c: F.exists(out, lambda o: (o["at"] < c["end"]) & (c["at"] < o["end"]) & ((o["rank"] != c["rank"]) | (o["at"] != c["at"])))
    kept = F.aggregate("every", F.slice("every", F.lit(1), F.lit(0)), lambda out, c: F.when(taken(out, c), out).otherwise(F.concat(out, F.array(c))))
    return rows.select(*keys, F.explode(kept).alias("c")).select(*keys, *(F.col(f"c.{c}") for c in columns if c not in ("rank", "at", "end")))


def mentions(bodies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cross references of every kind: ``doc_id, kind, begin, length, target``."""
    return bodies.select(*(keys or ["doc_id"]), F.inline(patterns.mentions(F.col("body"))))


def abbreviated_index(refs: DataFrame) -> DataFrame:
    """``doc_id, key, ref_index, ref_ord``: the entry that an abbreviated key in lower case stands for; the last of equal keys."""
    key = F.lower(F.col("ref_index").cast("string"))
    return refs.groupBy("doc_id", key.alias("key")).agg(F.max(F.struct("ref_ord", "ref_index")).alias("e")).select("doc_id", "key", F.col("e.ref_index").alias("ref_index"), F.col("e.ref_ord").alias("ref_ord"))


def abbreviated_linked(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Abbreviated citations with the entries of their keys, one row a key: ``doc_id, begin, key, ref_index, ref_ord``."""
    keys = found.where("kind = 'abbreviated'").select("doc_id", "begin", F.explode(F.split("content", "[,;]")).alias("key"))
    return keys.withColumn("key", F.trim("key")).join(abbreviated_index(refs).withColumnRenamed("key", "low"), ["doc_id"]).where(F.lower("key") == F.col("low")).drop("low")


def loosely_matched(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """The looser match of ``doc_id, author, year``: the only entry of the year, else the first whose start holds the author,
    else the first of the year. ``ref_ord`` is null where the year has no entry."""
    entries = refs.select("doc_id", "year", "ref_ord", signature(F.col("text")).alias("signature"))
    both = cited.join(entries, ["doc_id", "year"], "left")
    holds = F.contains(F.col("signature"), F.lower(F.trim("author")))
    out = both.groupBy(*cited.columns).agg(F.min(F.when(holds, F.col("ref_ord"))).alias("held"), F.min("ref_ord").alias("first"))
    return out.select(*cited.columns, F.coalesce("held", "first").alias("ref_ord"))


def inline_format(refs: DataFrame, sample: int = 25) -> DataFrame:
    """How a document's citations should look by its first ``sample`` entries: each entry votes for the first format that it
    begins with; ``format`` has the most votes (the first in order among equals), ``confidence`` its share."""
    order = Window.partitionBy("doc_id").orderBy("ref_ord")
    start = entry_start(F.col("text"))
    kinds = [*NUMBERED, AUTHOR_YEAR]
    vote = F.coalesce(*(F.when(t, F.lit(k)) for t, k in zip([*(begins(start, k) for k in NUMBERED), author_start(F.col("text"))], kinds, strict=True)), F.lit(UNKNOWN))
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("format"))
    told = refs.select("doc_id", "ref_ord", vote.alias("format"))  # votes are shuffled, not texts
    some = told.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    votes = some.groupBy("doc_id", "format").agg(F.count(F.lit(1)).alias("n"))
    total = votes.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("format") != UNKNOWN, F.struct("n", (-rank).alias("r"), "format"))).alias("best"))
    return total.select("doc_id", F.coalesce("best.format", F.lit(UNKNOWN)).alias("format"), F.coalesce(F.col("best.n") / F.col("total"), F.lit(0.0)).alias("confidence"))


def penalised(found: DataFrame, formats: DataFrame) -> DataFrame:
    """``found (doc_id, type, confidence, ...)`` with the confidence of types that don't go with the document's format times
    ``PENALTY``; superscripts never lose."""
    numbered, author = F.col("type").isin("numeric", "between"), F.col("type") == "author-year"
    odd = F.when(F.col("format") == AUTHOR_YEAR, numbered).otherwise(author)
    odd = odd | ((F.col("type") == "abbreviated") & (F.col("format") != "numbered-abbr")) | (numbered & (F.col("format") == "numbered-abbr"))
    out = found.join(formats.select("doc_id", "format"), "doc_id", "left")
    return out.withColumn("confidence", F.when(F.coalesce(odd, F.lit(False)), F.col("confidence") * PENALTY).otherwise(F.col("confidence"))).drop("format")


def superscripts(items: DataFrame, refs: DataFrame, body_height: float = 10.0) -> DataFrame:
    """Superscript citations of lines' items ``doc_id, page_no, line_no, item_no, text, x, width, height``: small items (below
    seven tenths of the body's height) less than half that height apart are one group; a group of numbers with an entry is
    a citation. ``doc_id, page_no, line_no, x, content, total, valid, confidence``."""
    small = items.where(F.col("height") < 0.7 * body_height)
    order = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("item_no")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    new = F.when((gap >= -1) & (gap < 0.5 * body_height), 0).otherwise(1)
    grouped = small.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text"))), lambda s: s["text"]), "")
    content = F.regexp_replace(F.regexp_replace(joined, r"^[^0-9]+|[^0-9]+$", ""), r"(?U)\s", "")
    one = grouped.groupBy("doc_id", "page_no", "line_no", "part").agg(F.min("x").alias("x"), content.alias("content"))
    one = one.where(F.regexp_like("content", F.lit("^[0-9]+(?:[-–—][0-9]+)?(?:,[0-9]+(?:[-–—][0-9]+)?)*$")))
    numbers = one.select("*", F.explode(expand_numbers(F.col("content"))).alias("number"))
    known = first_entries(refs).select("doc_id", F.col("ref_index").cast("string").alias("i"), F.lit(1).alias("known"))
    checked = numbers.withColumn("i", F.col("number").cast("string")).join(known, ["doc_id", "i"], "left")
    out = checked.groupBy("doc_id", "page_no", "line_no", "part", "x", "content").agg(F.count(F.lit(1)).alias("total"), F.count("known").alias("valid"))
    return out.where("valid > 0").select("doc_id", "page_no", "line_no", "x", "content", "total", "valid", F.round(F.col("valid") / F.col("total"), 6).alias("confidence"))


#: pages with fewer citations are searched for superscripts too (fixed value)
FEW = 5


def with_superscripts(found: DataFrame, raised: DataFrame) -> DataFrame:
    """Citations (``doc_id, page_no, type, begin, confidence``) and, on pages with fewer than five of them, the superscripts (of
    ``superscripts``) as well, with a null ``begin``."""
    columns = ["doc_id", "page_no", "type", "begin", "confidence"]
    found = cut(found.select(*columns))
    full = found.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW)
    more = raised.join(full, ["doc_id", "page_no"], "left_anti")
    return found.unionByName(more.select("doc_id", "page_no", F.lit("superscript").alias("type"), F.lit(None).cast("int").alias("begin"), "confidence"))


def inline_citations(pages: DataFrame, refs: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """All citations in the texts of pages (``doc_id, page_no, body``): numeric, abbreviated and author-year ones with at least
    one entry in ``refs``, none of which overlaps what an earlier rule has taken, penalised by the document's format.

    ``skip (doc_id, start_page, end_page)`` names reference sections: pages strictly between are left out. The result is
    ``doc_id, page_no, type, begin, refs, confidence, flags``; ``refs`` are the entries' places in the list, in order.
    """
    if skip is not None:
        inner = pages.join(skip.select("doc_id", "start_page", "end_page"), "doc_id", "left")
        pages = inner.where(~F.coalesce((F.col("page_no") > F.col("start_page")) & (F.col("page_no") < F.col("end_page")), F.lit(False))).drop("start_page", "end_page")
    keys = ["doc_id", "page_no"]
    # both are read by several branches
    pages, refs = cut(pages), cut(refs.select("doc_id", "ref_ord", "ref_index", "text", "year"))
    lettered = F.col("kind") == "abbreviated"
    ranges = F.when(lettered, False).otherwise(F.exists(number_items(F.col("content")), lambda s: s["last"].isNotNull()))
    numbers = F.transform(expand_numbers(F.col("content")), lambda n: n.cast("string"))
    listed = F.when(lettered, F.transform(F.split("content", "[,;]"), lambda k: F.lower(F.trim(k)))).otherwise(numbers)
    # citations and entries lie document by document by one shuffle each, and numbers are listed behind it; of equal indices the first entry counts, of keys the last
    asked = citations(pages, keys).select(*keys, "kind", "begin", "length", "content").unionByName(refs.where("doc_id IS NOT NULL").select("doc_id", F.col("ref_index").cast("string").alias("i"), "ref_ord"), allowMissingColumns=True)
    dealt = asked.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    named = F.col("kind").isNull()
    item = lambda sort, i: F.struct(sort.alias("lettered"), i.alias("i"))
    of_entry = F.array(item(F.lit(False), F.col("i")), item(F.lit(True), F.lower("i")))
    each = dealt.where(~named | F.col("i").isNotNull()).select(*keys, "kind", "begin", "length", "ref_ord", ranges.alias("ranges"), F.posexplode(F.when(named, of_entry).otherwise(F.transform(listed, lambda i: item(lettered, i)))).alias("place", "one"))
    same = Window.partitionBy("doc_id", "one.lettered", "one.i")
    both = each.withColumn("ref_ord", F.when(F.col("one.lettered"), F.max("ref_ord").over(same)).otherwise(F.min("ref_ord").over(same))).where(~named)
    order = F.transform(F.array_sort(F.collect_list(F.when(F.col("ref_ord").isNotNull(), F.struct("place", "ref_ord")))), lambda s: s["ref_ord"])
    marks = both.groupBy(*keys, "kind", "begin", "length", "ranges").agg(F.count(F.lit(1)).alias("total"), order.alias("refs")).where(F.size("refs") > 0)
    rank = F.when(F.col("kind") == "between", 0).when(F.col("kind") == "numeric", 1).otherwise(2)
    bits = F.when(F.col("ranges"), RANGE).otherwise(0) + F.when(F.size("refs") > 1, MULTI_REF).otherwise(0)
    one = marks.select(*keys, rank.alias("rank"), F.col("begin").alias("at"), (F.col("begin") + F.col("length")).alias("end"), "begin", F.when(F.col("kind") == "between", "numeric").otherwise(F.col("kind")).alias("type"), "refs", (F.size("refs") / F.col("total")).alias("confidence"), bits.alias("flags"))
    cited = matched_authors(author_years(pages, keys), refs)
    every = F.array_sort(F.collect_list(F.struct("year", "ref_ord")))
    authors = cited.groupBy(*keys, "rank", "at", "end", "begin").agg(F.transform(every, lambda s: s["ref_ord"]).alias("refs"), F.avg("confidence").alias("confidence"))
    many = F.when(F.size("refs") > 1, MULTI_REF + MULTI_YEAR).otherwise(0)
    two = authors.select(*keys, (F.col("rank") + 3).alias("rank"), "at", "end", "begin", F.lit("author-year").alias("type"), "refs", "confidence", many.alias("flags"))
    kept = claimed(one.unionByName(two), keys)
    return penalised(kept, inline_format(refs)).select(*keys, "type", "begin", "refs", F.round("confidence", 6).alias("confidence"), "flags")


def captions(lines: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Lines that define what cross references point at; of one kind and number the first counts.

    With ``metrics (doc_id, font_size)`` a line must also look like a definition, as ``is_definition``; lines then have ``first_item, style, h`` too.
    """
    found = lines.select("doc_id", "line_no", F.inline(patterns.definitions(F.col("text"))))
    if metrics is not None:
        shown = found.join(lines.select("doc_id", "line_no", "text", "first_item", "style", "h"), ["doc_id", "line_no"]).join(metrics.select("doc_id", "font_size"), "doc_id")
        found = shown.where(is_definition(F.col("kind"), F.col("text"), F.col("first_item"), F.col("style"), F.col("h"), F.col("font_size")))
    return found.groupBy("doc_id", "kind", "target").agg(F.min("line_no").alias("line_no"))


def is_definition(kind: Column, text: Column, first_item: Column, style: Column, size: Column, body_size: Column) -> Column:
    """Whether a line that begins as a caption does is one: by the sign behind its number, else by how its first item looks."""
    sign = F.regexp_like(text, F.lit(r"^\S+\s*[0-9]+(?:\.[0-9]+)?[A-Za-z]?\s*[:.]"))
    styled, larger = style > 0, size > 1.05 * body_size
    capitals = first_item == F.upper(first_item)
    caption = (styled | capitals) & (F.length(first_item) < 15)
    return (kind == "sectionMark") | sign | F.when(kind.isin("figure", "table"), caption).when(kind.isin("theorem", "algorithm"), styled | larger).otherwise(styled | larger | capitals)


def resolved(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Cross references with the line of the definition of their kind and number, where there is one."""
    return found.join(targets, ["doc_id", "kind", "target"], "left")


def entry_start(text: Column) -> Column:
    """What an entry begins with: an opening sign, a number or key, a closing sign, blanks, and the next character."""
    sign, number, closing, gap, following = (F.regexp_extract(text, r"(?U)^\s*([\[(]?)([0-9]+|[A-Z][A-Za-z]+\+?[0-9]{2}[a-z]?)([\]).]?)(\s*)(\S?)", k) for k in range(1, 6))
    return F.struct(sign.alias("sign"), number.alias("number"), closing.alias("closing"), (gap != "").alias("apart"), following.alias("following"))


def begins(start: Column, kind: str) -> Column:
    """Whether an entry that begins with ``start`` is of a numbered format."""
    digits = start["number"].rlike("^[0-9]")
    around = lambda a, b: (start["sign"] == a) & (start["closing"] == b)
    rules = {
        "numbered-bracket": digits & around("[", "]"),
        "numbered-paren": digits & around("(", ")"),
        "numbered-dot": digits & around("", ".") & start["apart"],
        "numbered-plain": digits & around("", "") & start["apart"] & start["following"].rlike("^[A-Z]"),
        "numbered-abbr": ~digits & (start["number"] != "") & around("[", "]"),
    }
    return rules[kind]


def author_start(text: Column) -> Column:
    """Whether an entry begins with a name and an initial and has a year of 1900 to 2099 later on."""
    return F.regexp_like(text, F.lit(r"^[A-Z][a-zÀ-ÿ]+[,\s]+[A-Z].*(?:19|20)[0-9]{2}"))


def entry_format(refs: DataFrame, sample: int = 50) -> DataFrame:
    """How a document's reference list is numbered: of its first 50 lines of more than ten characters (trimmed), the format
    that most begin with, the first in order among equals, if a tenth do; else ``author-year`` if 0.15 of them begin as such
    entries do; else ``hanging-indent`` if, of six lines or more with an ``x``, three are indented by more than half the
    ``font_size`` against the line before; else ``unknown``."""
    order = Window.partitionBy("doc_id").orderBy("ref_ord")
    long = refs.where(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) > 10)
    some = long.withColumn("nth", F.row_number().over(order)).where(f"nth <= {sample}")
    rises = F.col("x") > F.lag("x").over(order) + 0.5 * F.col("font_size") if {"x", "font_size"} <= set(refs.columns) else F.lit(False)
    some = some.withColumn("rises", F.coalesce(rises, F.lit(False))).withColumn("start", entry_start(F.col("text")))
    votes = [F.count_if(begins(F.col("start"), kind)).alias(f"v{k}") for k, kind in enumerate(NUMBERED)]
    counted = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(author_start(F.col("text"))).alias("authors"), F.count_if("rises").alias("rises"), *votes)
    best = F.array_max(F.array(*(F.struct(F.col(f"v{k}").alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(NUMBERED))))
    kind = F.when(best["v"] >= 0.1 * F.col("n"), best["name"]).when(F.col("authors") >= 0.15 * F.col("n"), AUTHOR_YEAR).when((F.col("n") >= 6) & (F.col("rises") >= 3), HANGING).otherwise(UNKNOWN)
    return refs.select("doc_id").distinct().join(counted.select("doc_id", kind.alias("format"), F.col("n").alias("sampled")), "doc_id", "left").select("doc_id", F.coalesce("format", F.lit(UNKNOWN)).alias("format"), F.coalesce("sampled", F.lit(0)).alias("sampled"))


def numbered_entries(lines: DataFrame, kind: str = "numbered-bracket") -> DataFrame:
    """Lines of reference lists joined to entries: a line that begins as ``kind`` does opens one, others go on; lines before the first are dropped."""
    start = entry_start(F.col("text"))
    number = F.when(begins(start, kind), start["number"]).otherwise("")
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = lines.withColumn("number", number).withColumn("entry", F.sum((F.col("number") != "").cast("int")).over(order)).where("entry > 0")
    listed = grouped.groupBy("doc_id", "entry").agg(F.max("number").alias("ref_index"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return listed.select("doc_id", "entry", "ref_index", F.array_join(F.transform("l", lambda s: s["text"]), " ").alias("text"))


def anchors(entries: DataFrame) -> DataFrame:
    """What is read from an entry's ``text``: its year (the first of 1900 to 2099, a letter perhaps), the 40 characters that
    authors are sought in, and whether the first 100 name several."""
    year = F.regexp_extract("text", r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2}[a-z]?)(?![A-Za-z0-9_])", 1)
    bare = F.regexp_replace("text", r"^[\[(]?[0-9]+[\]).\s]*", "")
    several = F.regexp_like(F.left("text", F.lit(100)), F.lit(r"(?i)(?<![a-z0-9_])(?:et\s+al|and)(?![a-z0-9_])|,.*,|&"))
    return entries.withColumn("year", F.nullif(year, F.lit(""))).withColumn("author_search_text", F.lower(F.left(bare, F.lit(40)))).withColumn("has_multiple_authors", several)


def entry_anchors(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Where entries begin and end: ``doc_id, entry, page_no, start_x, start_y, end_x, end_y, text`` and what ``anchors`` reads. ``entries``
    are ``doc_id, line_no, entry``; a place is half a line's height below its y, an end at the line's right edge."""
    rows = lines.join(entries.select("doc_id", "line_no", "entry"), ["doc_id", "line_no"])
    middle = F.col("y") - F.col("h") / 2
    first = F.min(F.struct("line_no", "page_no", F.col("x").alias("x"), middle.alias("y")))
    last = F.max(F.struct("line_no", (F.col("x") + F.col("w")).alias("x"), middle.alias("y")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")
    whole = rows.groupBy("doc_id", "entry").agg(first.alias("f"), last.alias("l"), F.trim(text).alias("text"))
    return anchors(whole.select("doc_id", "entry", "f.page_no", F.col("f.x").alias("start_x"), F.col("f.y").alias("start_y"), F.col("l.x").alias("end_x"), F.col("l.y").alias("end_y"), "text"))
