"""Scalar text functions: titles, headings, addresses, number lists, years, dates and colours, all as column expressions.

White space is Unicode white space and letters fold beyond ASCII, as the flags ``(?U)`` and ``(?iu)`` ask of Java.
A null input gives a null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hyphen, en dash, em dash (fixed values)
DASH = "[-–—]"
#: roman numerals that count as such (fixed values): I to XXV
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV")
#: numbers before a heading's text (fixed value)
SECTION_NUMBER = r"^(?:\d+(?:\.\d+)*\.?\s+|\(\d+\)\s*|[A-Z]\.(?:\d+(?:\.\d+)*\.?)?\s+|\([A-Za-z]\)\s*|[IVXLCDM]+\.\s+|\([IVXLCDM]+\)\s*)"
LONGEST_RANGE = 31


def given(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once: within a lambda an expression would be worked out again for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize_title(title: Column) -> Column:
    """Letters, digits and single spaces, lower case; null is empty."""
    kept = F.regexp_replace(F.regexp_replace(title, r"(?U)[^A-Za-z0-9\s]", ""), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.lower(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(""))


def strip_section_number(heading: Column) -> Column:
    return F.regexp_replace(heading, SECTION_NUMBER, "")


def normalize_heading(heading: Column) -> Column:
    """A heading for comparison: no section number, no leading "appendix", then as a title."""
    return F.regexp_replace(normalize_title(strip_section_number(F.trim(heading))), r"^appendix\s*(?:[a-z]\s+)?", "")


def number_prefix(heading: Column) -> Column:
    """Dotted digits, a capital with at most one number, or a roman numeral before a heading's first word; empty if none."""
    return F.regexp_extract(heading, r"^([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)?|[IVXLCDM]+)\.?\s+\S", 1)


def number_depth(prefix: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", 0).otherwise(F.size(F.split(prefix, r"\.")))


def prefix_parts(prefix: Column) -> Column:
    """Components of a section number: digits as they are, I to XXV as roman, other capitals as 1 to 26, the rest 0."""
    roman = F.create_map(*(x for i, r in enumerate(ROMAN) for x in (F.lit(r), F.lit(i + 1))))

    def part(p: Column) -> Column:
        letter = F.when(p.rlike("^[A-Z]$"), F.ascii(p) - 64)
        return F.coalesce(F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")), F.try_element_at(roman, p), letter, F.lit(0))

    return F.when(F.coalesce(prefix, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(prefix, r"\."), part))


def appendix_letter(title: Column) -> Column:
    """``A`` of "Appendix A", "A. Title" or "A Title"; empty if none."""
    named = F.upper(F.regexp_extract(title, r"(?i)^\s*appendix\s+([A-Z])(?![A-Za-z0-9_])", 1))
    return F.when(named != "", named).otherwise(F.regexp_extract(title, r"^\s*([A-Z])(?:\.|\s)", 1))


def title_case(text: Column) -> Column:
    """At least 5 characters and 2 words, three fifths of which begin with a capital A to Z."""
    words = F.split(F.trim(text), r"(?U)[\s.]+")
    return (F.length(text) >= 5) & (F.size(words) >= 2) & (F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) >= 0.6 * F.size(words))


def overlap(a: Column, b: Column) -> Column:
    """How many of the words of ``a``, repeats included, are in ``b``; both are arrays."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w)))


def titles_match(a: Column, b: Column) -> Column:
    """Whether two normalised titles agree: the shorter, of 15 characters or more, begins the longer; or at least half the
    words of ``a``, which has three or more, are in ``b``. Not symmetric."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    words = F.split(a, " ")
    begins = (F.length(short) >= 15) & F.startswith(long, short)
    return (a != "") & (b != "") & (begins | ((F.size(words) >= 3) & (given(F.split(b, " "), lambda others: overlap(words, others)) >= 0.5 * F.size(words))))


def similar_titles(a: str, b: str) -> bool:
    """Whether two normalised titles are equal or agree by the rule of ``titles_match``, for passes in Python."""
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    words, others = a.split(" "), set(b.split(" "))
    return a == b or (len(short) >= 15 and long.startswith(short)) or (len(words) >= 3 and sum(w in others for w in words) >= 0.5 * len(words))


def url_fragment(url: Column) -> Column:
    """What identifies an address: arXiv number, DOI, or host and path; the address itself if it has no host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    arxiv, doi = F.regexp_extract(path, r"/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1), F.regexp_extract(path, r"/(10\.[0-9]{4,}/\S+)", 1)
    plain = F.concat(F.lower(host), F.when(path == "", F.lit("/")).otherwise(path))
    known = F.when(arxiv != "", arxiv).when(F.contains(F.lower(host), F.lit("doi.org")) & (doi != ""), doi)
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(host == "", url).otherwise(F.coalesce(known, plain))


def file_name(url: Column, default: str = "document.pdf") -> Column:
    """The last part of an address's path, with ``.pdf`` at its end."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", F.lit(default)).when(F.lower(last).endswith(".pdf"), last).otherwise(F.concat(last, F.lit(".pdf")))


def number_items(content: Column) -> Column:
    """``1-3, 5; 7`` as an array of (first, last, is_range); items that aren't numbers are dropped."""

    def item(x: Column) -> Column:
        whole = F.get(x, F.lit(0)).try_cast("int")
        some = F.regexp_extract(F.get(x, F.lit(0)), r"^([0-9]{1,9})(?![0-9])", 1).try_cast("int")
        last = F.when((F.size(x) == 2) & whole.isNotNull(), F.get(x, F.lit(1)).try_cast("int"))
        return F.struct(F.coalesce(whole, some).alias("first"), last.alias("last"))

    # an item is its pieces around dashes: one number or two
    pieces = F.transform(F.split(content, r"\s*[,;]\s*"), lambda x: F.split(F.trim(x), rf"\s*{DASH}\s*"))
    return F.filter(F.transform(pieces, item), lambda s: s["first"].isNotNull())


def expand_numbers(content: Column) -> Column:
    """The numbers of a bracket: a range gives at most 31 from its first on, a single number counts from 1 to 999."""

    def numbers(s: Column) -> Column:
        last = F.least(s["last"], s["first"] + (LONGEST_RANGE - 1))
        one = F.when((s["first"] > 0) & (s["first"] < 1000), F.array(s["first"])).otherwise(F.array().cast("array<int>"))
        return F.when(s["last"].isNull(), one).when(last >= s["first"], F.sequence(s["first"], F.greatest(last, s["first"]))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(number_items(content), numbers))


def abbreviated_keys(content: Column) -> Column:
    """The items of a bracket that contain an abbreviated key such as ``ABC+23``."""
    return F.filter(F.transform(F.split(content, r"\s*[,;]\s*"), lambda x: F.trim(x)), lambda x: x.rlike(r"[A-Z][a-zA-Z]+\+?[0-9]{2}[a-z]?"))


def years(text: Column) -> Column:
    """``2009a,b, 2011`` as 2009a, 2009b, 2011; what isn't a year, such as 1996-2004, is dropped."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    none = F.lit("").cast("string")
    start = F.struct(none.alias("year"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        whole, letter = item.rlike("^[0-9]{4}[a-z]?$"), item.rlike("^[a-z]$") & (state["year"] != "")
        value = F.when(whole, item).when(letter, F.concat(state["year"], item))
        carried = F.when(item.rlike("^[0-9]{4}[a-z]$"), F.left(item, F.lit(4))).when(letter, state["year"]).otherwise(none)
        return F.struct(carried.alias("year"), F.when(value.isNotNull(), F.concat(state["out"], F.array(value))).otherwise(state["out"]).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def pdf_date(value: Column) -> Column:
    """``D:YYYYMMDDHHMM...`` as ``YYYY-MM-DD HH:MM``; another text as it is, nothing as ``Unknown``."""
    parts = F.regexp_extract(value, r"^D:([0-9]{12})", 1)
    made = F.regexp_replace(parts, r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1-$2-$3 $4:$5")
    return F.when(F.coalesce(value, F.lit("")) == "", "Unknown").when(parts != "", made).otherwise(value)


def shown_time(value: Column) -> Column:
    """A time as ``YYYY-MM-DD HH:MM``; ``Unknown`` where there is none."""
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit("Unknown"))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def clean_copy(text: Column) -> Column:
    """Text as it goes to the clipboard: no NUL, line feeds as spaces, words joined across a hyphen and a space."""
    return F.replace(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\r?\n", " "), F.lit("- "), F.lit(""))


def rgb(color: Column) -> Column:
    """``#rrggbb`` as (red, green, blue)."""
    part = lambda at: F.conv(F.substr(color, F.lit(at), F.lit(2)), 16, 10).cast("int")
    return F.struct(part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"))


def page_range(query: Column, start: Column, total: Column) -> Column:
    """The last page of a search range: ``+n`` counts from ``start``, a number is a page; clamped to ``total``, null unless beyond ``start``."""
    plus = F.regexp_extract(query, r"^\+\s*([0-9]{1,9})$", 1)
    page = F.regexp_extract(query, r"^\s*([0-9]{1,9})\s*$", 1)
    to = F.when(plus != "", F.least(start + F.try_to_number(plus, F.lit("999999999")).cast("int"), total)).when(page != "", F.least(F.try_to_number(page, F.lit("999999999")).cast("int"), total))
    return F.when(to > start, to)


def search_range(first: Column, last: Column, titles: Column, pages: Column, total: Column) -> Column:
    """``(from, to)`` of a ranged search. ``first`` is a page's number or part of a section's title, ``last`` that or ``+n`` pages; ``titles`` and
    ``pages`` are the sections in order. Anything else is page 1 and the last page; ``to`` is null unless beyond ``from``."""

    def page(q: Column) -> Column:
        number = F.try_to_number(F.nullif(F.regexp_extract(q, r"^\s*([0-9]{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int")
        wanted = F.lower(F.trim(q))
        hit = F.array_position(F.transform(titles, lambda t: F.contains(F.lower(t), wanted)), True)
        return F.coalesce(F.when(number.between(1, total), number), F.when((wanted != "") & (hit > 0), F.get(pages, (hit - 1).cast("int"))))

    start = F.coalesce(page(first), F.lit(1))
    plus = F.try_to_number(F.nullif(F.regexp_extract(last, r"^\s*\+\s*([0-9]{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int")
    end = F.coalesce(F.when(plus.isNotNull(), F.least(start + plus, total)), page(last))
    return F.struct(start.alias("from"), F.when(end > start, end).alias("to"))


def metadata(values: Column) -> Column:
    """A map of a document's facts with "Unknown" for what is missing or empty."""
    return F.transform_values(values, lambda k, v: F.coalesce(F.nullif(v, F.lit("")), F.lit("Unknown")))


def linked_parts(text: Column) -> Column:
    """A text as parts ``(text, url)`` in order: addresses and arXiv numbers with where they lead, what lies between with null."""
    pattern = r"https?://[^\s<>\"]+[^\s<>\".,;:)\]]|(?i:arxiv):\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?"
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.lit(None).cast("string")
    number = lambda h: F.regexp_extract(h, r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)$", 1)
    url = lambda h: F.when(h.rlike("^https?://"), h).otherwise(F.concat(F.lit("https://arxiv.org/abs/"), number(h)))
    pairs = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.array(F.struct(x["g"].alias("text"), none.alias("url")), F.struct(x["h"].alias("text"), url(x["h"]).alias("url"))))
    return F.filter(F.flatten(pairs), lambda s: F.coalesce(s["text"], F.lit("")) != "")


def base64_text(content: Column, mime: str = "application/pdf") -> Column:
    """Bytes as a ``data:`` address."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def truncate_words(text: Column, most: int) -> Column:
    """At most ``most`` characters, three full stops behind what was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def fit_scale(width: Column, height: Column, room: Column, tall: Column) -> Column:
    """The scale at which a page fits into a room."""
    return F.least(room / width, tall / height)


def scroll_target(offset: Column, page_height: Column, top: Column, scale: Column) -> Column:
    """Where to scroll to for a place ``top`` above a page's bottom."""
    return offset + (page_height - top) * scale
