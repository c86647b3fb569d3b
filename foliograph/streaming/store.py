"""A keyed table that streams put into, take from and delete from, batch by batch, each once.

A table is a folder. ``data`` has the rows of each bucket of keys in folders that never change once written; ``log`` has a small file for each
version, which says for every bucket what folder holds it, and which batch of which stream made the version. A version exists when
its log file does: it is written aside and renamed, which no file system that Spark knows lets two writers do with one name. So readers
see the version before or after a batch and nothing between; a batch that failed half-way leaves folders that no version names; and a batch
that is given again finds itself in the log and changes nothing. Only the buckets that a batch touches are written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliograph.functions.folds import cut, laid_out, so_far

BUCKETS = 64
#: versions that a writer tries when others commit at the same time
TRIES = 10


class Files:
    """Small files of a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.java = spark._jvm.org.apache.hadoop.fs
        self.gateway = spark.sparkContext._gateway
        self.folder = self.java.Path(folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.folder.getFileSystem(conf)
        self.context = self.java.FileContext.getFileContext(self.fs.getUri(), conf)
        self.spark = spark

    def path(self, name: str):
        return self.java.Path(self.folder, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet, whole or not at all; False if it is."""
        aside = self.path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.exists(self.path(name)):
                return False
            self.context.rename(aside, self.path(name), self.gateway.new_array(self.java.Options.Rename, 0))
            return True
        except Exception:
            if self.fs.exists(self.path(name)):
                return False
            raise
        finally:
            if self.fs.exists(aside):
                self.fs.delete(aside, False)


class KeyedTable:
    """Rows of ``schema`` by ``keys``, one a key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema)
        self.log = Files(spark, f"{self.folder}/log")

    def version(self) -> dict:
        """The newest version: its number, each bucket's folder, and the last batch of every stream."""
        numbers = [int(n[:-5]) for n in self.log.names() if n.endswith(".json") and n[0] != "."]
        return json.loads(self.log.read(f"{max(numbers):020d}.json")) if numbers else {"number": 0, "folders": {}, "batches": {}}

    def rows(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of the newest (or a given) version, or those of some buckets."""
        folders = (version or self.version())["folders"]
        there = sorted({f for b, f in folders.items() if buckets is None or int(b) in buckets})
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{f}" for f in there))

    def apply(self, changes: DataFrame, stream: str, batch: int) -> bool:
        """Applies changes (the table's columns, ``op`` put, take or delete, ``at`` and ``event_id``, which order those of a key), once for each
        ``stream`` and ``batch``; False if that batch is in already. What takes found is in ``taken``.

        A put replaces a key's row, a delete removes it, a take removes it and keeps it as found. Rows with a null key change nothing.
        """
        names, order = self.schema.names, ["at", "event_id"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        whole = F.struct(*names)
        for _ in range(TRIES):
            version = self.version()
            if version["batches"].get(stream, -1) >= batch:
                return False
            valid = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)).select(*names, *(c for c in ("op", "at", "event_id")))
            new = cut(valid.withColumn("bucket", bucket))
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS rows at most
            before = self.rows(version, touched)
            # a take finds what the change before it put, or, if it is a key's first, the row that was there
            seen = so_far(laid_out(new.withColumn("row", whole), self.keys, order), self.keys, order, last={"held": F.struct("op", "row")})
            stored = before.select(*self.keys, F.struct(*names).alias("stored"))
            takes = seen.where("op = 'take'").select(*self.keys, "event_id", "held").join(stored, self.keys, "left")
            found = F.when(F.col("held").isNull(), F.col("stored")).when(F.col("held.op") == "put", F.col("held.row"))
            last = new.groupBy(*self.keys).agg(F.max(F.struct("at", "event_id", "op", whole.alias("row"))).alias("c"))
            kept = before.join(last.select(*self.keys), self.keys, "left_anti").select(*names)
            after = kept.unionByName(last.where("c.op = 'put'").select("c.row.*")).withColumn("bucket", bucket)
            made = f"{version['number'] + 1:020d}-{uuid.uuid4().hex}"
            after.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{made}")
            takes.select("event_id", found.alias("found")).where("found IS NOT NULL").select("event_id", "found.*").write.parquet(f"{self.folder}/taken/{made}")
            filled = {int(n[7:]) for n in Files(self.spark, f"{self.folder}/data/{made}").names() if n.startswith("bucket=")}
            folders = {b: f for b, f in version["folders"].items() if int(b) not in touched} | {str(b): f"{made}/bucket={b}" for b in touched if b in filled}
            entry = {"number": version["number"] + 1, "folders": folders, "batches": version["batches"] | {stream: batch}, "taken": made, "of": [stream, batch]}
            if self.log.write_new(f"{entry['number']:020d}.json", json.dumps(entry)):
                return True
        raise RuntimeError(f"other writers committed {TRIES} times")

    def taken(self) -> DataFrame:
        """``event_id`` and the row found of every take of all versions."""
        folders = [json.loads(self.log.read(n))["taken"] for n in sorted(self.log.names()) if n.endswith(".json") and n[0] != "."]
        schema = StructType.fromDDL("event_id long")
        for f in self.schema.fields:
            schema = schema.add(f)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/taken/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a stream's batches, each once, whatever is given again after a failure."""

        def write(changes: DataFrame, batch: int) -> None:
            self.apply(changes, stream, batch)

        return write
