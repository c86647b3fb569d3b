"""Citations in brackets, mentions of other parts and captions by patterns, as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.text import given

#: citations in brackets (fixed values): numbers and ranges, a range between two brackets, and keys of letters and a year
NUMERIC = r"\[(\d+(?:\s*[-–—]\s*\d+)?(?:\s*[,;]\s*\d+(?:\s*[-–—]\s*\d+)?)*)\]"
BETWEEN = r"\[(\d+)\]\s*[-–—]\s*\[(\d+)\]"
ABBREVIATED = r"\[([A-Z][a-zA-Z]+(?:\+)?\d{2}[a-z]?(?:\s*[,;]\s*[A-Z][a-zA-Z]+(?:\+)?\d{2}[a-z]?)*)\]"
#: how far a range between brackets may rise (fixed value)
MOST_SPAN = 30
#: mentions of other parts, in whatever case, and the group that names the part (fixed values)
MENTIONS = {
    "figure": (r"\b(?:Fig(?:ure|s)?\.?\s*)([A-Z]?\d+[a-z]?(?:\s*[-–—]\s*[A-Z]?\d+[a-z]?)?(?:\s*[,&]\s*[A-Z]?\d+[a-z]?)*)", 1),
    "table": (r"\bTab(?:le|s)?\.?\s+([A-Z]?\d+[a-z]?(?:\s*[–—,-]\s*[A-Z]?\d+[a-z]?)*)", 1),
    "section": (r"\b(?:Sec(?:tion|s)?\.?\s+)((?:[A-Z]|\d+)(?:\.\d+)*)", 1),
    "sectionMark": (r"§\s*((?:[A-Z]|\d+)(?:\.\d+)*)", 1),
    "equation": (r"\b(?:Eq(?:uation|n|s)?\.?\s*)\(?(\d+(?:\.\d+)?)\)?", 1),
    "algorithm": (r"\b(?:Alg(?:orithm|s)?\.?\s*)(\d+)", 1),
    "theorem": (r"\b(Theorem|Lemma|Proposition|Corollary|Definition)\s+(\d+(?:\.\d+)?)", 2),
    "appendix": (r"\b(?:Appendix|App\.)\s+([A-Z](?:\.\d+)?)", 1),
}
#: what a line begins with that defines a part, in whatever case, and the group that names it (fixed values, but for the possessive
#: sign in a theorem's number, which is read whole: "Theorem 1.2 Let" doesn't define theorem 1)
DEFINITIONS = {
    "figure": (r"^(?:Fig(?:ure)?\.?\s*)(\d+[a-z]?)\s*[:.]", 1),
    "table": (r"^(?:Tab(?:le)?\.?\s*)(\d+[a-z]?)\s*[:.]*", 1),
    "algorithm": (r"^(?:Algorithm\.?\s*)(\d+)\s*[:.]", 1),
    "theorem": (r"^(Theorem|Lemma|Proposition|Corollary|Definition)\s+(\d+(?:\.\d+)?+)\s*[:.]", 2),
    "sectionMark": (r"^§\s*(\d+(?:\.\d+)*)\s", 1),
}


def exact(pattern: str) -> str:
    """A pattern for Java: digits are those of ASCII, white space is that of Unicode, and a word begins after what is no letter, digit or
    underscore of ASCII, here and in every version."""
    blank = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    return pattern.replace(r"\d", "[0-9]").replace(r"\s", blank).replace(r"\b", "(?<![A-Za-z0-9_])")


#: what stands around matches while they are taken apart, and what takes its place in a text: no pattern tells the two apart
SIGN, INSTEAD = "\x01", "\x02"


def matches(text: Column, pattern: str) -> Column:
    """``begin, length, text`` of every match in order. The text is searched once: matches get a sign on either side, at which it is split, so
    that every second piece is a match, and places are sums of the pieces' lengths."""
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(SIGN), F.lit(INSTEAD)), pattern, f"{SIGN}$0{SIGN}"), SIGN, -1)
    row = "array<struct<begin:int,length:int,text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast(row).alias("out"))

    def step(held: Column, piece: Column) -> Column:
        one = F.struct(held["at"].alias("begin"), F.length(piece).alias("length"), piece.alias("text"))
        return F.struct((held["at"] + F.length(piece)).alias("at"), (~held["match"]).alias("match"), F.when(held["match"], F.concat(held["out"], F.array(one))).otherwise(held["out"]).alias("out"))

    return given(pieces, lambda p: F.when(F.size(p) > 1, F.aggregate(p, start, step, lambda held: held["out"])).otherwise(F.array().cast(row)))


def overlapping(taken: Column, m: Column) -> Column:
    return F.exists(taken, lambda t: (t["begin"] < m["begin"] + m["length"]) & (m["begin"] < t["begin"] + t["length"]))


def bracket_citations(text: Column) -> Column:
    """``kind, begin, length, content`` of all citations in brackets: ranges between brackets that rise by ``MOST_SPAN`` at most, then lists of
    numbers, then lists of keys; what overlaps an earlier kind's is left out."""
    made = lambda kind, content: lambda m: F.struct(F.lit(kind).alias("kind"), m["begin"].alias("begin"), m["length"].alias("length"), content(m["text"]).alias("content"))
    end = lambda m, k: F.regexp_extract(m["text"], exact(BETWEEN), k).try_cast("long")
    pairs = F.filter(matches(text, exact(BETWEEN)), lambda m: (end(m, 1) < end(m, 2)) & (end(m, 2) <= end(m, 1) + MOST_SPAN))
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)

    def rest(taken: Column) -> Column:
        numbers = F.filter(matches(text, exact(NUMERIC)), lambda m: ~overlapping(taken, m))
        keys = matches(text, exact(ABBREVIATED))  # can't overlap numbers
        ranges = F.transform(taken, made("between", lambda t: F.concat_ws("-", *(F.regexp_extract(t, exact(BETWEEN), k).cast("long").cast("string") for k in (1, 2)))))
        return F.concat(ranges, F.transform(numbers, made("numeric", inner)), F.transform(keys, made("abbreviated", inner)))

    return F.element_at(F.transform(F.array(pairs), rest), 1)


def mentions(text: Column) -> Column:
    """``kind, begin, length, target`` of every mention of another part."""
    of = lambda kind, pattern, group: F.transform(matches(text, pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["begin"].alias("begin"), m["length"].alias("length"), F.regexp_extract(m["text"], pattern, group).alias("target")))
    return F.concat(*(of(kind, "(?i)" + exact(pattern), group) for kind, (pattern, group) in MENTIONS.items()))


def definitions(text: Column) -> Column:
    """``kind, target`` of a line that begins as a caption or a heading with a section mark does, in an array; an empty one for another. Every
    pattern is tried once."""
    tried = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, "(?i)" + exact(pattern), group).alias("target")) for kind, (pattern, group) in DEFINITIONS.items()))
    return F.slice(F.filter(tried, lambda t: t["target"] != ""), 1, 1)


def definition(text: Column) -> Column:
    """``kind, target`` of a line that begins as a caption or a heading with a section mark does; null for another."""
    return F.get(definitions(text), 0)
