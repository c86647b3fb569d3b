"""File sources: binary documents with their magic bytes checked, candidates found in pages, and data addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions.text import file_name

#: how a PDF file begins (fixed value)
MAGIC = "%PDF-"


def binary_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder that begin as PDF files do: ``path, name, length, content``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(has_magic(F.col("content"))).select("path", file_name(F.col("path")).alias("name"), "length", "content")


def has_magic(content: Column) -> Column:
    return F.coalesce(F.substr(content, F.lit(1), F.lit(len(MAGIC))) == F.lit(MAGIC.encode()), F.lit(False))


def acceptable(status: Column, content_type: Column, disposition: Column) -> Column:
    """Whether a response is a PDF to show: status 200, its type, and not an attachment."""
    return F.coalesce((status == 200) & F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False)) & ~F.coalesce(F.contains(F.lower(disposition), F.lit("attachment")), F.lit(False))


def data_bytes(value: Column) -> Column:
    """Base64, with or without a ``data:`` prefix, as bytes."""
    return F.unbase64(F.when(F.startswith(value, F.lit("data:")), F.substring_index(value, ",", -1)).otherwise(value))


#: the frame that viewers show a PDF in (fixed value)
FRAME = "pdf-iframe"


def candidates(pages: DataFrame) -> DataFrame:
    """The best candidate of a page (``page_id, url, html``): itself if its path ends so, else the frame of the known id, else frames whose path
    names a PDF, else typed embeds, in their order."""
    return every_candidate(pages).groupBy("page_id", "url").agg(F.min(F.struct("rank", "place", "candidate"))["candidate"].alias("candidate")).select("page_id", "candidate")


def every_candidate(pages: DataFrame) -> DataFrame:
    """All candidates of a page in the order in which they are tried, each once: ``page_id, url, rank, place, candidate``; a page without any
    has one row of nulls."""
    row = "array<struct<rank:int,place:int,url:string>>"
    source = lambda tag: F.regexp_extract(tag, r'(?i)\s(?:src|data)="([^"]*)"', 1)

    def of(rank: int, tags: str, keep) -> Column:
        tagged = F.transform(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), lambda t, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), F.when(keep(t), source(t)).alias("url")))
        return F.filter(tagged, lambda s: F.coalesce(s["url"], F.lit("")) != "").cast(row)

    path = lambda t: F.lower(F.regexp_replace(F.regexp_replace(source(t), r"[?#].*$", ""), "^[a-z]+://[^/]*", ""))
    itself = F.when(F.lower(F.regexp_replace("url", r"[?#].*$", "")).endswith(".pdf"), F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("place"), F.col("url").alias("url"))).cast(row)).otherwise(F.array().cast(row))
    known = of(1, r"(?is)<iframe\s[^>]*>", lambda t: F.lower(t).contains(f'id="{FRAME}"'))
    framed = of(2, r"(?is)<iframe\s[^>]*>", lambda t: F.contains(path(t), F.lit("pdf")))
    typed = of(3, r"(?is)<(?:embed|object)\s[^>]*>", lambda t: F.lower(t).contains('type="application/pdf"'))
    every = pages.select("page_id", "url", F.explode_outer(F.concat(itself, known, framed, typed)).alias("c")).select("page_id", "url", "c.rank", "c.place", F.col("c.url").alias("candidate"))
    return every.groupBy("page_id", "url", "candidate").agg(F.min(F.struct("rank", "place")).alias("f")).select("page_id", "url", "f.rank", "f.place", "candidate")


def newest(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Settings ``key, store, value``: the primary store's, else the mirror's, else the default's."""
    picked = settings.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy((F.col("store") != "primary").cast("int"), "store"))).where("nth = 1").select("key", "value")
    return defaults.select("key", F.col("value").alias("default")).join(picked, "key", "left").select("key", F.coalesce("value", "default").alias("value"))
