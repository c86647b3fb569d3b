"""Stored rows by key: the newest state of tables that are changed, updates of single fields, and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(changes: DataFrame, key: list[str], at: str = "at") -> DataFrame:
    """The state after all changes (``op`` put or delete, a time, and the row): each key's last one, unless it deletes. Of
    changes at one time a delete counts last."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), (F.col("op") != "delete").cast("int")))
    return changes.withColumn("nth", nth).where("nth = 1 and op <> 'delete'").drop("nth", "op")


def updated(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with the fields that updates supply: null leaves a field as it is; of several updates of one row the last that
    supplies a field counts. ``updated_at`` becomes the last update's; ``cleared`` (an array of names) empties fields."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("updated_at").alias("t"), F.col(c).alias("v"))))["v"].alias(f"new_{c}")
    given = updates.groupBy(key).agg(*(last(c) for c in fields), F.max("updated_at").alias("new_updated_at"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("cleared", F.array().cast("array<string>"))))).alias("gone"))
    both = rows.join(given, key, "left")
    value = lambda c: F.when(F.array_contains("gone", c), F.lit(None)).otherwise(F.coalesce(F.col(f"new_{c}"), F.col(c)))
    return both.select(*(value(c).alias(c) if c in fields else F.coalesce("new_updated_at", "updated_at").alias(c) if c == "updated_at" else F.col(c) for c in rows.columns))


def setting(value: Column, kind: str) -> Column:
    """A stored setting as a value of ``kind``: JSON, or the text as it is where it is none (as older versions stored it)."""
    plain = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string", {"mode": "PERMISSIVE"})["v"]
    return F.try_variant_get(F.try_parse_json(F.to_json(F.struct(F.coalesce(plain, value).alias("v")))), "$.v", kind) if kind != "string" else F.coalesce(plain, value)


def first_source(rows: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """Which of several sources (columns, in order) a document is loaded from: ``source`` and ``value``, both null without any."""
    pick = F.coalesce(*(F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("source"), F.col(s).cast("string").alias("value"))) for s in sources))
    return rows.select(key, pick.alias("p")).select(key, "p.source", "p.value")


def exported(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON in a folder, which must not be there yet."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
