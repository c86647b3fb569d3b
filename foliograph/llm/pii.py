"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions are used. For each kind a text is cut at the pattern's matches; the lengths of the pieces and
of the matches, added up, give each match's place in code points. The sums are made in blocks, so that a text with very
many matches costs little more than its length. The patterns are possessive and look behind, so that a match is sought
once for each run of its characters and a long run costs linear time.

A span's score starts from what its validator is worth, rises with a context word that speaks for its kind among the
``NEAR`` characters before it (up to the match before), and falls with one that speaks against it. Base kinds (``email
ip card phone``) always stay once confirmed, whatever their score. The method adds spans of other kinds (``iban ssn
secret``) from ``THRESHOLD`` on: account numbers with the right remainder, social security numbers, and long keys of
mixed letters and digits, the last two only with a word that speaks for them.

Null texts are empty ones, and have no spans. Equal starts are listed in the order of ``KINDS``. Repeated rows are
treated alike, each by itself; a null id stays null. An empty table gives no row. Other columns are ignored; an input
column may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: what a text must contain for a kind to be sought at all, and the kind's pattern
PATTERNS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++"),
    "phone": (r"+", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": (None, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}"),
}
#: words that speak for a kind when they stand shortly before a span
CONTEXT = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|mastercard|amex|payment|credit",
    "phone": r"phone|tel\b|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": r"ssn|social security|security number",
    "secret": r"key|token|secret|passw|credential|auth",
}
#: words that speak against any kind
AGAINST = r"example|sample|version|release|isbn|checksum|commit|revision"
#: score of a confirmed span without context; context adds the boost
SCORE = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "secret": 0.4}
BOOST = 0.3
#: different characters that a key must have, of which some are letters and some digits
DIVERSE = 8
#: lengths that are added up at a time
BLOCK = 128
THRESHOLD = 0.6
NEAR = 30
SPAN = "struct<kind:string,rank:int,begin:int,end:int,score:double>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, blanks removed, leaves 1 modulo 97 by ISO 7064: its head moved to its end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).when(c.rlike("^[A-Z]$"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda part: ~part.rlike("^0*(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = digits(value)
        return F.length(n).between(14, 19) & luhn(n)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DIVERSE)
    return ~value.rlike("^(?:000|666|9)|-00-|-0000$")


def given(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once: a lambda's variable, not the expression, stands in its place."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(lengths: Column) -> Column:
    """Each length added to all before it: within blocks first, then the blocks' sums."""
    none = F.array().cast("array<int>")
    last = lambda out: F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0))
    summed = lambda xs: F.aggregate(xs, none, lambda out, n: F.concat(out, F.array(last(out) + n)))
    starts = lambda xs: F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(BLOCK))).otherwise(none)
    # a block's sums begin at 0, so its last one is its whole length
    in_blocks = lambda xs: F.transform(starts(xs), lambda at: summed(F.slice(xs, at + 1, F.lit(BLOCK))))
    shifted = lambda blocks: F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0)), summed(F.transform(blocks, last))), lambda b, shift: F.transform(F.coalesce(b, none), lambda n: n + shift)))
    return given(lengths, lambda xs: given(in_blocks(xs), shifted))


def pieces(kind: str, text: Column) -> tuple[Column, Column]:
    """What lies before, between and behind a kind's matches, and the matches."""
    pattern = PATTERNS[kind][1]
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sought(kind: str, text: Column) -> Column:
    """Whether a text has any match of a kind."""
    need, pattern = PATTERNS[kind]
    found = F.rlike(text, F.lit(pattern))
    return found if need is None else F.contains(text, F.lit(need)) & found


def scored(kind: str, gap: Column) -> Column:
    """A confirmed span's score by the words shortly before it."""
    before = F.lower(F.right(gap, F.lit(NEAR)))
    up, down = (F.when(before.rlike(words), F.lit(BOOST)).otherwise(F.lit(0.0)) for words in (CONTEXT[kind], AGAINST))
    return F.round(F.least(F.lit(SCORE[kind]) + up - down, F.lit(1.0)), 2)


def good(kind: str, gap: Column, hit: Column) -> Column:
    """Whether a match is confirmed and, for kinds that the method adds, sure enough."""
    sound = F.coalesce((hit != "") & confirmed(kind, hit), F.lit(False))
    return sound if kind in BASE else sound & (scored(kind, gap) >= THRESHOLD)


def proposals(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, in order."""
    gaps, hits = pieces(kind, text)
    rank = KINDS.index(kind)
    # a match ends where all gaps and matches up to it do
    ends = lambda p: running(F.zip_with(p["gaps"], p["hits"], lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0))))
    row = lambda x: F.struct(F.coalesce(x["gap"], F.lit("")).alias("gap"), F.coalesce(x["hit"], F.lit("")).alias("hit"), x["end"].alias("end"))
    rows = lambda p: F.transform(F.arrays_zip(p["gaps"].alias("gap"), p["hits"].alias("hit"), ends(p).alias("end")), row)
    span = lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (x["end"] - F.length(x["hit"])).alias("begin"), x["end"].alias("end"), scored(kind, x["gap"]).alias("score"))
    spans = given(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda p: F.transform(F.filter(rows(p), lambda x: good(kind, x["gap"], x["hit"])), span)).cast(f"array<{SPAN}>")
    return F.when(sought(kind, text), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, column: str = "pii_spans", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with the spans of all kinds in ``column``, by begin and then kind."""
    text = F.coalesce("text", F.lit(""))
    each = F.concat(*(proposals(k, text) for k in kinds))
    ordered = F.transform(F.array_sort(F.transform(each, lambda s: F.struct(s["begin"], s["rank"], s["kind"], s["end"], s["score"]))), lambda s: F.struct(s["kind"], s["rank"], s["begin"], s["end"], s["score"]))
    return docs.withColumn(column, ordered.cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: base counts, the digest of the base spans, all spans, and their scores in the spans' order."""
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    of = lambda kind: F.filter("pii_spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    added = F.size(F.filter("pii_spans", lambda s: s["rank"] >= len(BASE))).cast("long").alias("n_added")
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), added, scores)


def redacted(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, one kind after the other in the order of ``kinds``.

    Columns and their types stay; ``n_chars``, where there is one, is the new length. A null text stays null.
    """
    text = F.col("text")
    for kind in kinds:
        gaps, hits = pieces(kind, text)
        mark = F.lit(f"[{kind.upper()}]")
        parts = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: F.concat(x["gap"], F.when(good(kind, x["gap"], F.coalesce(x["hit"], F.lit(""))), mark).otherwise(F.coalesce(x["hit"], F.lit("")))))  # noqa: B023
        docs = docs.withColumn("text", F.when(sought(kind, text), F.array_join(parts, "")).otherwise(text))
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs
