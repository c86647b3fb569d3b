"""Deterministic document structures made from the star-schema tables, in Spark, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_A_LINE = 12
LINES_A_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, holding: str | None = None, pages: int | None = None) -> DataFrame:
    """``documents`` typeset: paragraphs at line feeds, twelve words a line, forty lines a page. No shuffle: one pass over each row. With
    ``holding``, a word in whatever case, only documents that hold it are typeset; a word is never cut by a line's end. With ``pages`` the same lines as
    without, of so many first pages: later paragraphs, which are a line each at least, aren't cut into words."""
    words = lambda p: F.filter(F.split(p, " "), lambda w: w != "")
    chunk = lambda ws, k: F.struct(F.array_join(F.slice(ws, k * WORDS_A_LINE + 1, WORDS_A_LINE), " ").alias("text"), ((k == 0) & (F.size(ws) <= 8)).alias("bold"))
    of = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ws) / WORDS_A_LINE), F.lit(1)).cast("int") - 1), lambda k: chunk(ws, k))
    paragraphs = F.split("text", "\n")
    if pages is not None:
        paragraphs = F.slice(F.filter(paragraphs, lambda p: F.trim(p) != ""), 1, pages * LINES_A_PAGE)
    made = F.flatten(F.transform(F.filter(F.transform(paragraphs, words), lambda ws: F.size(ws) > 0), of))
    made = made if pages is None else F.slice(made, 1, pages * LINES_A_PAGE)
    docs = table(spark, sf_dir, "documents")
    docs = docs.where(F.contains(F.lower("text"), F.lit(holding.lower()))) if holding else docs
    rows = docs.select("doc_id", F.posexplode(made).alias("line_no", "line"))
    at = F.col("line_no") % LINES_A_PAGE
    return rows.select(
        "doc_id",
        "line_no",
        (F.floor(F.col("line_no") / LINES_A_PAGE) + 1).cast("int").alias("page_no"),
        F.col("line.text").alias("text"),
        F.when((F.col("doc_id") % 2 == 1) & (at >= 20), 324.0).otherwise(72.0).alias("x"),
        (750.0 - 18.0 * at).alias("y"),
        (5.0 * F.length("line.text")).alias("w"),
        F.when(F.col("line.bold"), 14.0).otherwise(10.0).alias("h"),
        F.col("line.bold").cast("int").alias("style"),
    )


LINES_SQL = """
paragraphs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pn FROM documents),
split_words AS (SELECT doc_id, pn, list_filter(string_split(p, ' '), lambda w: w <> '') AS ws FROM paragraphs),
chunks AS (SELECT doc_id, pn, ws, unnest(range(((len(ws) + 11) // 12)::BIGINT)) AS k FROM split_words WHERE len(ws) > 0),
ordered AS (SELECT doc_id, array_to_string(ws[k * 12 + 1 : k * 12 + 12], ' ') AS text, k = 0 AND len(ws) <= 8 AS bold, row_number() OVER (PARTITION BY doc_id ORDER BY pn, k) - 1 AS line_no FROM chunks),
lines AS (SELECT doc_id, line_no::INT AS line_no, (line_no // 40 + 1)::INT AS page_no, text, CASE WHEN doc_id % 2 = 1 AND line_no % 40 >= 20 THEN 324.0 ELSE 72.0 END::DOUBLE AS x,
  (750.0 - 18.0 * (line_no % 40))::DOUBLE AS y, (5.0 * length(text))::DOUBLE AS w, CASE WHEN bold THEN 14.0 ELSE 10.0 END::DOUBLE AS h, bold::INT AS style FROM ordered)
"""


def author(key) -> F.Column:
    """a surname made from a key: Q and a letter for each digit."""
    return F.concat(F.lit("Q"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a paper, each of its line items an entry of its reference list: ``doc_id, ref_ord, ref_index, text, year, author``.

    The entries' order is that of all columns, since line numbers repeat within an order.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", F.row_number().over(order).alias("ref_ord"))
    year = F.year("l_shipdate").cast("string")
    text = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] "), author(F.col("l_suppkey")), F.lit(", A. Part "), F.col("l_partkey").cast("string"), F.lit(". Title. "), year, F.lit("."))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "ref_ord", F.col("l_linenumber").alias("ref_index"), text.alias("text"), year.alias("year"), author(F.col("l_suppkey")).alias("author"))


REFERENCES_SQL = """
refs AS MATERIALIZED (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))::INT AS ref_ord, l_linenumber AS ref_index,
  '[' || l_linenumber || '] Q' || translate(l_suppkey::VARCHAR, '0123456789', 'abcdefghij') || ', A. Part ' || l_partkey || '. Title. ' || year(l_shipdate) || '.' AS text,
  year(l_shipdate)::VARCHAR AS year, 'Q' || translate(l_suppkey::VARCHAR, '0123456789', 'abcdefghij') AS author FROM lineitem)
"""


#: sentences of the papers, one an order by its key: plain text, and what is to be found in it. Braces name columns of
#: ``PAPERS_SQL``: the least and greatest line number, their count, an author and a year. What is to be found is a family,
#: its kind, the text, and what it stands for: for brackets the content and the numbers as SQL, for authors the year.
SENTENCES = (
    ["As shown in ", ("bracket", "numeric", "[{lo}-{hi}, {n}]", "{lo}-{hi}, {n}", "list_append(range(lo, least(hi, lo + 30) + 1), n)"), " and by ", ("author", "one", "{a}", "{y}"), " et al. ({y}), see ", ("mention", "figure", "Fig. {n}", "{n}"), " and ", ("mention", "table", "Table {hi}", "{hi}"), "; ", ("mention", "section", "Section {lo}.{n}", "{lo}.{n}"), " and ", ("bracket", "between", "[{hi}]–[{hi2}]", "{hi}-{hi2}", "range(hi, hi + 3)"), " go on, as do ", ("bracket", "abbreviated", "[ABC+9{lo}]", "ABC+9{lo}", None), " and ", ("bracket", "numeric", "[40-90]", "40-90", "range(40, 71)"), "."],
    ["Others (see ", ("author", "block", "{a}", "{y}"), ", {y}; Nobody, 1901; among others) prove ", ("mention", "equation", "Eq. ({n}.{lo})", "{n}.{lo}"), ", ", ("mention", "algorithm", "Algorithm {hi}", "{hi}"), " and ", ("mention", "theorem", "Lemma {lo}", "{lo}"), " [", ("bracket", "numeric", "[{lo}; {hi}]", "{lo}; {hi}", "[lo, hi]"), "]."],
    ["(", ("author", "block", "{a}", "{y}"), ", {y}, pp. 3-4) as in ", ("mention", "sectionMark", "§ {lo}.{n}", "{lo}.{n}"), ", ", ("mention", "appendix", "App. B.{hi}", "B.{hi}"), ", not in configs {n}, ", ("mention", "figure", "FIGURE {lo}a – {n}b, {hi}", "{lo}a – {n}b, {hi}"), " nor ", ("bracket", "numeric", "[{hi}]", "{hi}", "[hi]"), "-", ("bracket", "numeric", "[1]", "1", "[1]"), ", but in ", ("bracket", "numeric", "[{lo} — {hi}]", "{lo} — {hi}", "range(lo, least(hi, lo + 30) + 1)"), "."],
    ["No citation: [see {n}], [A1], (in {y}), Sect {lo}, tabletop {hi}, and ", ("mention", "table", "tab. S{lo}, S{hi}", "S{lo}, S{hi}"), "; ", ("author", "one", "{a}", "{y}"), "'s ({y}) is one, ", ("bracket", "abbreviated", "[Kno8{lo}, TeX9{hi}b]", "Kno8{lo}, TeX9{hi}b", None), " two."],
)
_COLUMNS = {"lo": "lo", "hi": "hi", "n": "n", "hi2": "(hi + 2)", "a": "author", "y": "y"}


def _parts(template: str) -> list[tuple[bool, str]]:
    """A template as plain parts and names in braces (True)."""
    import re

    return [(k % 2 == 1, x) for k, x in enumerate(re.split(r"\{(\w+)\}", template)) if x or k % 2]


def sql_text(template: str) -> str:
    return " || ".join(f"{_COLUMNS[x]}::VARCHAR" if named else "'" + x.replace("'", "''") + "'" for named, x in _parts(template)) or "''"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each order that cites its entries and points at other parts: ``doc_id, body``."""
    # sentences are short and reading them takes long: as many tasks as shuffles have, not as few as the bytes would fill
    items = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    rows = items.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("s"), F.min(F.year("l_shipdate")).alias("y"))
    of = {"hi2": F.col("hi") + 2, "a": author(F.col("s"))}
    text = lambda t: F.concat(*(of.get(x, F.col(x) if named else None).cast("string") if named else F.lit(x) for named, x in _parts(t)))
    whole = ["".join(x if isinstance(x, str) else x[2] for x in sentence) for sentence in SENTENCES]
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.coalesce(*(F.when(F.col("l_orderkey") % len(whole) == k, text(t)) for k, t in enumerate(whole))).alias("body"))


PAPERS_SQL = "papers AS MATERIALIZED (SELECT l_orderkey AS doc_id, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) AS n, 'Q' || translate(min(l_suppkey)::VARCHAR, '0123456789', 'abcdefghij') AS author, min(year(l_shipdate)) AS y FROM lineitem GROUP BY 1)"


def marked_sql(family: str) -> str:
    """What the sentences hold of one family: ``doc_id, kind, begin, length, content, ns, author, y`` from ``papers``."""
    found = []
    for k, sentence in enumerate(SENTENCES):
        before = ""
        for x in sentence:
            if not isinstance(x, str) and x[0] == family:
                numbers = x[4] if len(x) > 4 and x[4] else "NULL"
                found.append(f"SELECT doc_id, '{x[1]}' AS kind, length({sql_text(before)})::INT AS \"begin\", length({sql_text(x[2])})::INT AS length, {sql_text(x[3])} AS content, {numbers}::BIGINT[] AS ns, author, y FROM papers WHERE doc_id % {len(SENTENCES)} = {k}")
            before += x if isinstance(x, str) else x[2]
    return " UNION ALL ".join(found)
