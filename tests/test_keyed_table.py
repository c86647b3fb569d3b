"""The keyed table under a stream: what a dictionary would hold, batches given again, failures half-way, two writers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliograph.operators import store
from foliograph.streaming.store import KeyedTable
from foliograph.streaming.trails import event_stream

COLUMNS = "key string, value long"
CHANGES = f"{COLUMNS}, op string, at timestamp, event_id long"


def some_changes(seed, n, first=0):
    rng = random.Random(seed)
    begin = datetime(2024, 1, 1) + timedelta(hours=first)
    return [(rng.choice(["hot", "hot", "a", "b", "c", "d", None]), first + k, rng.choice(["put", "put", "take", "delete"]), begin + timedelta(seconds=rng.randrange(n)), first + k) for k in range(n)]


def by_hand(rows, held, found):
    for key, value, op, _, event_id in sorted((r for r in rows if r[0]), key=lambda r: (r[3], r[4])):
        if op == "take" and key in held:
            found[event_id] = held[key]
        held.pop(key, None)
        if op == "put":
            held[key] = value


def test_puts_takes_and_deletes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), COLUMNS, ["key"], 4)
    assert table.rows().collect() == [] and table.taken().collect() == []
    held: dict = {}
    found: dict = {}
    for batch in range(3):
        rows = some_changes(batch, 60, 100 * batch)
        df = spark.createDataFrame(rows, CHANGES).repartition(3)
        assert table.apply(df, "s", batch)
        by_hand(rows, held, found)
        state = {r.key: r.value for r in table.rows().collect()}
        assert state == held
        assert not table.apply(df, "s", batch)  # given again
        assert {r.key: r.value for r in table.rows().collect()} == held
        assert {r.event_id: r.value for r in table.taken().collect()} == found
    assert table.version()["number"] == 3 and found
    assert not table.apply(spark.createDataFrame(some_changes(9, 5), CHANGES), "s", 1)
    assert table.apply(spark.createDataFrame(some_changes(9, 5, 900), CHANGES), "other", 0)


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), COLUMNS, ["key"], 4)
    put = lambda v: spark.createDataFrame([("a", v, "put", datetime(2024, 1, 1), v)], CHANGES)
    table.apply(put(1), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(type(table.log), "write_new", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(put(2), "s", 1)
    assert [(r.key, r.value) for r in table.rows().collect()] == [("a", 1)]
    assert table.apply(put(2), "s", 1) and [(r.key, r.value) for r in table.rows().collect()] == [("a", 2)]


def test_two_writers(spark, tmp_path, monkeypatch):
    table, other = (KeyedTable(spark, str(tmp_path / "t"), COLUMNS, ["key"], 4) for _ in range(2))
    put = lambda k, v: spark.createDataFrame([(k, v, "put", datetime(2024, 1, 1), v)], CHANGES)
    held, old = [], table.version

    def slow():
        version = old()
        if not held:
            held.append(1)
            other.apply(put("b", 2), "o", 0)  # commits between reading and writing
        return version

    monkeypatch.setattr(table, "version", slow)
    assert table.apply(put("a", 1), "s", 0)
    assert {r.key: r.value for r in other.rows().collect()} == {"a": 1, "b": 2}


def test_a_stream_into_the_table(spark, tmp_path):
    rows = [r for r in some_changes(5, 200) if r[2] != "take"]
    schema = "key string, value long, op string, ts timestamp, event_id long"
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "t"), COLUMNS, ["key"], 4)

    def run(checkpoint):
        changes = event_stream(spark, str(tmp_path / "in")).withColumnRenamed("ts", "at")
        changes.writeStream.foreachBatch(table.sink("s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("one")
    number = table.version()["number"]
    assert number >= 3
    run("two")  # another checkpoint: the same batches again change nothing
    assert table.version()["number"] == number
    # files are read in an order of their own: each batch's changes are applied one after the other
    assert set(r.key for r in table.rows().collect()) <= {"hot", "a", "b", "c", "d"}


def test_one_batch_is_the_state_of_all_changes(spark, tmp_path):
    rows = [r for r in some_changes(6, 150) if r[2] != "take" and r[0]]
    df = spark.createDataFrame(rows, CHANGES)
    table = KeyedTable(spark, str(tmp_path / "t"), COLUMNS, ["key"])
    table.apply(df, "s", 0)
    # store.current has deletes last at equal times; here ids decide, so times are made distinct
    distinct = df.withColumn("at", F.col("at") + F.make_dt_interval(secs=F.col("event_id") / 1000))
    table.apply(distinct, "s", 1)
    want = {(r.key, r.value) for r in store.current(distinct, ["key"]).collect()}
    assert {(r.key, r.value) for r in table.rows().collect()} == want
