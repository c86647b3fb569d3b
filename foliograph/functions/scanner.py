"""A reader of citations by author and year: small rules over characters, put together by hand, for what ``patterns`` can't say.

A rule takes a text and a place and returns the place behind what it read, or ``None``. The reader goes
through a text once for each rule, takes the leftmost reading, and goes on behind it. Places are in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# fixed values: words that citations are known by
#: small words before a surname, with either case of their first letter
PARTICLES = ("de", "von", "van", "der", "den", "le", "la", "del", "dos", "das", "di", "du")
#: what stands between two authors
CONJUNCTIONS = ("and", "&amp;", "&", "＆")
#: phrases that may open a parenthesis, and those of them that may follow another
OPENERS = ("e.g.", "i.e.", "see also", "see", "cf.", "compare", "inter alia:")
EXAMPLES = ("e.g.", "i.e.")
LONGEST_FIRST = tuple(sorted(OPENERS, key=len, reverse=True))
#: phrases that may close it
CLOSERS = ("among others", "amongst others", "and others")
DASHES = "-–—"

DIGITS = frozenset("0123456789")


def blanks(t: str, p: int) -> int:
    while p < len(t) and t[p].isspace():
        p += 1
    return p


def spaced(t: str, p: int) -> int | None:
    """At least one blank."""
    q = blanks(t, p)
    return q if q > p else None


def digits(t: str, p: int) -> int | None:
    q = p
    while q < len(t) and t[q] in DIGITS:
        q += 1
    return q if q > p else None


def one_of(t: str, p: int, signs: str) -> int | None:
    return p + 1 if p < len(t) and t[p] in signs else None


def maybe(t: str, p: int, signs: str) -> int:
    return p + 1 if p < len(t) and t[p] in signs else p


def ascii_letter(c: str, low: str = "a", high: str = "z") -> bool:
    return low <= c <= high


def listed(t: str, p: int, item: Callable[[str, int], int | None], signs: str) -> int | None:
    """Items with one of ``signs`` between them, blanks around it."""
    end = item(t, p)
    while end is not None:
        sign = one_of(t, blanks(t, end), signs)
        following = item(t, blanks(t, sign)) if sign is not None else None
        if following is None:
            return end
        end = following
    return None


# ---- authors and years


#: a capital and at least one more letter, mark, apostrophe or hyphen
PROPER = regex.compile(r"\p{Lu}[\p{L}\p{M}'’\-]+")
BY_LETTER = {c: tuple(w for w in (*PARTICLES, *(w.capitalize() for w in PARTICLES)) if w[0] == c) for c in {x for w in PARTICLES for x in (w[0], w[0].upper())}}


def particle(t: str, p: int) -> int | None:
    for w in BY_LETTER.get(t[p : p + 1], ()):
        if t.startswith(w, p) and (q := spaced(t, p + len(w))) is not None:
            return q
    return None


def surname(t: str, p: int) -> int | None:
    """A particle perhaps, then a capital and at least one more letter, mark, apostrophe or hyphen."""
    if (q := particle(t, p)) is not None and (end := surname_itself(t, q)) is not None:
        return end
    return surname_itself(t, p)


def surname_itself(t: str, p: int) -> int | None:
    m = PROPER.match(t, p)
    return m.end() if m else None


def and_others(t: str, p: int) -> int:
    """``et al``, or nothing."""
    q = spaced(t, p)
    if q is None or not t.startswith("et", q) or (q := spaced(t, q + 2)) is None or not t.startswith("al", q):
        return p
    return maybe(t, q + 2, ".")


def conjunction(t: str, p: int) -> int | None:
    return next((p + len(w) for w in CONJUNCTIONS if t.startswith(w, p)), None)


def year(t: str, p: int) -> int | None:
    """Four digits, a small letter perhaps, further letters after commas."""
    if (q := digits(t, p)) is None or q < p + 4:
        return None
    q = p + 4
    if q < len(t) and ascii_letter(t[q]):
        q += 1
    while q + 1 < len(t) and t[q] == "," and ascii_letter(t[q + 1]):
        q += 2
    return q


def page_note(t: str, p: int) -> int:
    """A comma and pages, or nothing."""
    if p >= len(t) or t[p] != ",":
        return p
    q = blanks(t, p + 1)
    for w in ("pp.", "p."):
        if t.startswith(w, q):
            q = blanks(t, q + len(w))
            break
    if (end := digits(t, q)) is None:
        return p
    last = digits(t, end + 1) if end < len(t) and t[end] in "-–" else None
    return end if last is None else last


def years_and_pages(t: str, p: int) -> tuple[int, int] | None:
    """The places behind the years and behind the pages."""
    end = listed(t, p, year, ",")
    return None if end is None else (end, page_note(t, end))


def parenthesis(t: str, p: int) -> tuple[int, str] | None:
    """Years in parentheses: the place behind them, and the years."""
    p = blanks(t, p)
    inner = years_and_pages(t, p + 1) if one_of(t, p, "(") is not None else None
    end = one_of(t, inner[1], ")") if inner else None
    return None if end is None else (end, t[p + 1 : inner[0]])


def opener(t: str, p: int) -> int:
    """The phrase that a parenthesis may begin with, blanks behind it included."""
    phrase = next((w for w in LONGEST_FIRST if t.startswith(w, p)), None)
    if phrase is None:
        return p
    p += len(phrase)
    if phrase in EXAMPLES:
        p = maybe(t, p, ",")
    more = blanks(t, maybe(t, p, ","))
    if (w := next((w for w in EXAMPLES if t.startswith(w, more)), None)) is not None:
        p = maybe(t, more + len(w), ",")
    return blanks(t, p)


def joined_by_and(t: str, p: int, tight: bool = False) -> tuple[int, int] | None:
    """Blanks, a conjunction and a further author: where that one begins and ends. ``tight``: blanks behind may be missing."""
    q = spaced(t, p)
    q = conjunction(t, q) if q is not None else None
    if q is None or (start := blanks(t, q) if tight else spaced(t, q)) is None or (end := surname(t, start)) is None:
        return None
    return start, end


def after_comma(t: str, p: int) -> tuple[int, int] | None:
    """A comma, blanks and a further author."""
    start = spaced(t, p + 1) if one_of(t, p, ",") is not None else None
    end = surname(t, start) if start is not None else None
    return None if end is None else (start, end)


def three(t: str, p: int) -> tuple[int, str] | None:
    """``A, B, and C`` or ``A, B and C``: the place behind it, and A."""
    first = surname(t, p)
    second = after_comma(t, first) if first is not None else None
    third = joined_by_and(t, maybe(t, second[1], ",")) if second else None
    return None if third is None else (third[1], t[p:first])


def dated(t: str, p: int) -> tuple[int, str] | None:
    """A comma perhaps, years and pages up to a closing parenthesis."""
    q = blanks(t, maybe(t, blanks(t, p), ","))
    inner = years_and_pages(t, q)
    end = one_of(t, inner[1], ")") if inner else None
    return None if end is None else (end, t[q : inner[0]])


Cited = tuple[int, str, str | None, str]  # the place behind it, first author, second author, years


def two_outside(t: str, p: int) -> Cited | None:
    first = surname(t, p)
    second = joined_by_and(t, first, tight=True) if first is not None else None
    out = parenthesis(t, second[1]) if second else None
    return None if out is None else (out[0], t[p:first], t[second[0] : second[1]], out[1])


def three_outside(t: str, p: int) -> Cited | None:
    authors = three(t, p)
    out = parenthesis(t, authors[0]) if authors else None
    return None if out is None else (out[0], authors[1], None, out[1])


def three_inside(t: str, p: int) -> Cited | None:
    authors = three(t, opener(t, p + 1)) if one_of(t, p, "(") is not None else None
    out = dated(t, authors[0]) if authors else None
    return None if out is None else (out[0], authors[1], None, out[1])


def two_inside(t: str, p: int) -> Cited | None:
    if one_of(t, p, "(") is None:
        return None
    start = opener(t, p + 1)
    first = surname(t, start)
    second = joined_by_and(t, first) if first is not None else None
    out = dated(t, second[1]) if second else None
    return None if out is None else (out[0], t[start:first], t[second[0] : second[1]], out[1])


def one_outside(t: str, p: int) -> Cited | None:
    first = surname(t, p)
    out = parenthesis(t, maybe(t, and_others(t, first), ",")) if first is not None else None
    return None if out is None else (out[0], t[p:first], None, out[1])


def one_inside(t: str, p: int) -> Cited | None:
    if one_of(t, p, "(") is None:
        return None
    start = opener(t, p + 1)
    first = surname(t, start)
    out = dated(t, and_others(t, first)) if first is not None else None
    return None if out is None else (out[0], t[start:first], None, out[1])


def pair_and_others(t: str, p: int) -> Cited | None:
    first = surname(t, p)
    second = after_comma(t, first) if first is not None else None
    more = and_others(t, second[1]) if second else None
    out = parenthesis(t, maybe(t, more, ",")) if second and more > second[1] else None
    return None if out is None else (out[0], t[p:first], t[second[0] : second[1]], out[1])


#: the order in which single citations claim text, after blocks
SINGLE = (two_outside, three_outside, three_inside, two_inside, one_outside, one_inside, pair_and_others)


#: those of them that begin with a parenthesis, and what all of them hold: four digits before something that may follow a year
INSIDE = frozenset((three_inside, two_inside, one_inside))
DATED = regex.compile(r"[0-9]{4}")
#: where years in parentheses begin
OPENED = regex.compile(r"\([0-9]{4}")


def block_part(t: str, p: int) -> Cited | None:
    """One citation of a block: one, two or three authors, or two with a comma between them, then years and pages."""
    first = surname(t, p)
    if first is None:
        return None
    comma, joined = after_comma(t, first), joined_by_and(t, first)
    third = joined_by_and(t, maybe(t, comma[1], ",")) if comma else None
    for second, behind in ((comma, third and third[1]), (joined, joined and joined[1]), (comma, comma and comma[1]), (None, first)):
        if behind is None:
            continue
        q = blanks(t, maybe(t, blanks(t, and_others(t, behind)), ","))
        if (inner := years_and_pages(t, q)) is not None:
            return inner[1], t[p:first], t[second[0] : second[1]] if second else None, t[q : inner[0]]
    return None


def block(t: str, p: int) -> tuple[int, list[tuple[int, Cited]]] | None:
    """A parenthesis of citations with semicolons between them: the place behind it, and each one's place and reading."""
    if one_of(t, p, "(") is None:
        return None
    start, parts = opener(t, p + 1), []
    while (part := block_part(t, start)) is not None:
        parts.append((start, part))
        sign = one_of(t, blanks(t, part[0]), ";")
        if sign is None or surname(t, blanks(t, sign)) is None:
            break
        start = blanks(t, sign)
    if not parts or part is None:
        return None
    end = part[0]
    tail = blanks(t, end)
    tail = blanks(t, tail + 1) if tail < len(t) and t[tail] == ";" else tail
    phrase = next((w for w in CLOSERS if t.startswith(w, tail)), None)
    closed = one_of(t, tail + len(phrase) if phrase else end, ")")
    return None if closed is None else (closed, parts)


def each_year(text: str) -> list[str]:
    """``2009a,b, 2011`` as 2009a, 2009b and 2011."""
    out: list[str] = []
    for item in (x.strip() for x in text.split(",")):
        if len(item) == 1 and out and len(out[-1]) == 5:
            out.append(out[-1][:4] + item)
        elif item[:4].isdigit():
            out.append(item)
    return out


def may_start(t: str, openings: bool) -> Iterator[int]:
    """Places where an author's name or a parenthesis may begin."""
    if openings:
        p = t.find("(")
        while p >= 0:
            yield p
            p = t.find("(", p + 1)
        return
    for m in name_starts().finditer(t):
        yield m.start()


@lru_cache(1)
def name_starts() -> regex.Pattern:
    return regex.compile(r"\p{Lu}|(?:" + "|".join(f"[{w[0]}{w[0].upper()}]{w[1:]}" for w in PARTICLES) + r")(?=\s)")


def author_citations(t: str) -> Iterator[tuple[int, int, int, int, str, str | None, str]]:
    """``rank, at, end, begin, author, second, year`` by every rule, overlaps between rules included: blocks have rank 0, a
    block's citations its whole place from ``at`` to ``end``."""
    if "(" not in t or not DATED.search(t):
        return
    openings = [*may_start(t, True)]
    # years in parentheses follow the names of the other rules
    last = max((m.start() for m in OPENED.finditer(t)), default=0)
    names = [p for p in may_start(t, False) if p < last and surname(t, p) is not None] if last else []
    behind = 0
    for p in openings:
        if p >= behind and (found := block(t, p)) is not None:
            behind = found[0]
            for begin, (_, author, second, years) in found[1]:
                yield from ((0, p, behind, begin, own(author), second, y) for y in each_year(years))
    for rank, rule in enumerate(SINGLE, 1):
        behind = 0
        for p in openings if rule in INSIDE else names:
            if p >= behind and (found := rule(t, p)) is not None:
                behind, author, second, years = found
                yield from ((rank, p, behind, p, own(author), second, y) for y in each_year(years))


def own(author: str) -> str:
    """An author without a possessive s."""
    return author[:-2] if author.endswith(("'s", "’s")) else author


# ---- on Spark


ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def read_by(texts: DataFrame, keys: list[str], column: str, read: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """What ``read`` finds in ``column`` of each row, a row each, beside the row's ``keys``. Null texts give nothing."""
    names = [f.split() for f in fields.split(", ")]
    kinds = [ARROW[kind] for _, kind in names]
    plain = texts.select(*keys, column)
    schema = ", ".join([*(f"{k} {plain.schema[k].dataType.simpleString()}" for k in keys), fields])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                for row in read(text) if text else ():
                    at.append(k)
                    rows.append(row)
            owner = pa.array(at, pa.int64())
            own = {k: batch.column(i).take(owner) for i, k in enumerate(keys)}
            yield pa.RecordBatch.from_pydict(own | {n: pa.array([r[i] for r in rows], kind) for i, ((n, _), kind) in enumerate(zip(names, kinds, strict=True))})

    return plain.mapInArrow(run, schema)
