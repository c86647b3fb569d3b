"""Reading history as streams: clicks that wait for papers and are taken once, permissions, answers that are kept, and plain joins by time.

Timestamps are cast to TIMESTAMP first, since watermarks reject those without a time zone.

``in_event_order`` takes the very steps of the batch operators over a stream. Rows are held until the watermark has passed them, then
go through the step in order of time; so a stream gives the rows that the batch operator gives over the same events, however they arrive
within the watermark's delay, and what is later than that is dropped. What a key holds is list state; a timer wakes it when its next row is due
and when what it holds is too old to matter, and clears it. State is in RocksDB, which the session must name as its state store (``keep_state``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliograph.operators import trails
from foliograph.operators.trails import KEPT, LIFETIME_MINUTES, LOOKED_UP, PASS, WAITING

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, as ``in_event_order`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Rows of a key that wait for the watermark, and what its step holds."""

    def __init__(self, columns: list[str], row_schema: str, held_schema: str, names: list[str], order: list[str], step: Callable[[list, dict], Iterable[tuple]], lifetime: float) -> None:
        self.columns, self.row_schema, self.held_schema, self.names, self.order, self.step = columns, row_schema, held_schema, names, order, step
        self.lifetime = int(lifetime * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.row_schema)
        self.held = handle.getListState("held", self.held_schema)

    def wake(self, at: int) -> None:
        """At the first watermark beyond ``at`` (microseconds): a timer goes off once the watermark is past its millisecond."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.rows.appendList(new)
        self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        past = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [dict(zip(self.columns, r, strict=True)) for r in self.rows.get()] if self.rows.exists() else []
        due = sorted((r for r in waiting if r["at"] <= past), key=lambda r: tuple(r[o] for o in self.order))
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        for row in due:
            for out in self.step(held, row):
                yield Row(**dict(zip(self.names, out, strict=True)))
        later = [tuple(r[c] for c in self.columns) for r in waiting if r["at"] > past]
        held = [h for h in held if h[0] + self.lifetime >= past]
        for state, values in ((self.rows, later), (self.held, held)):
            if values:
                state.put(values)
            else:
                state.clear()
        if later:
            self.wake(min(r[0] for r in later))
        if held:
            self.wake(held[-1][0] + self.lifetime)


def in_event_order(rows: DataFrame, keys: list[str], columns: list[str], order: list[str], schema: str, held_schema: str, step: Callable[[list, dict], Iterable[tuple]], lifetime: float, delay: str) -> DataFrame:
    """A stream's rows (``ts``, ``at``, the same in microseconds, ``keys`` and ``columns``) through ``step(held, row)`` in order of time, by key.

    ``held`` is a list of tuples of ``held_schema``, whose first value is a time; a row of ``lifetime`` seconds' age must not matter any more.
    """
    columns = ["at", *(c for c in dict.fromkeys([*columns, *keys]) if c != "at")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    seen = rows.select("ts", *columns).withWatermark("ts", delay)
    return seen.groupBy(*keys).transformWithState(_InOrder(columns, kinds, held_schema, StructType.fromDDL(schema).names, order, step, lifetime), schema, "append", "eventTime")


def taken_clicks(clicks: DataFrame, opened: DataFrame, minutes: int = LIFETIME_MINUTES, most: int = WAITING, delay: str = "1 minute") -> DataFrame:
    """``trails.matched`` over streams of clicks and opened papers."""
    rows = trails.both_sides(trails.titled(clicks), trails.titled(opened), "ts", "user_id", "title", "fragment").where("user_id is not null")
    return in_event_order(rows, ["user_id"], ["kind", "event_id", "title", "fragment"], ["at", "kind", "event_id"], "open_id long, click_id long", "at long, event_id long, title string, fragment string", trails.take_click(minutes, most), minutes * 60, delay)


def passes(permits: DataFrame, pages: DataFrame, seconds: float = PASS, delay: str = "1 minute") -> DataFrame:
    """``trails.passed`` over streams of permissions and page views."""
    rows = trails.both_sides(permits, pages, "ts", "url").where("url is not null")
    return in_event_order(rows, ["url"], ["kind", "event_id"], ["at", "kind", "event_id"], "page_id long, permit_id long", "at long, event_id long", trails.let_pass(seconds), seconds, delay)


def lookups(requests: DataFrame, kept: float = KEPT, delay: str = "1 minute") -> DataFrame:
    """``trails.looked_up`` over a stream of requests."""
    rows = requests.withColumn("at", F.unix_micros("ts")).select("ts", "at", "client", "key", "event_id", "ok")
    return in_event_order(rows, ["client", "key"], ["event_id", "ok"], ["at", "event_id"], LOOKED_UP, "at long", trails.look_up(kept), kept, delay)


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream; files appear once, exactly, by the checkpoint."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def pending_pairs(events: DataFrame, minutes: int = LIFETIME_MINUTES) -> DataFrame:
    """Views of a stream with the clicks of their user at most ``minutes`` older; later clicks are dropped by the watermark."""
    late = f"{minutes} minutes"
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("click_user"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")).withWatermark("click_ts", late)
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("open_id"), F.col("ts").alias("open_ts")).withWatermark("open_ts", late)
    near = F.expr(f"click_user = user_id AND open_ts >= click_ts AND open_ts <= click_ts + INTERVAL {minutes} MINUTES")
    return views.join(clicks, near).select("user_id", "open_id", "click_id", "open_ts", "click_ts")


def last_waiting(events: DataFrame, most: int = WAITING) -> DataFrame:
    """After every batch, each of its users' last ``most`` clicks, newest first; state is ``most`` pairs a user."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held += zip(pdf.ts.astype("int64").tolist(), pdf.event_id.tolist(), strict=True)
        held = sorted(held, reverse=True)[:most]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({"user_id": key[0], "event_ids": [[h[1] for h in held]]})

    clicks = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    return clicks.groupBy("user_id").applyInPandasWithState(keep, "user_id long, event_ids array<long>", "ts array<long>, ids array<long>", "update", "NoTimeout")
