"""Streams that keep state: the same rows as the batch operators, over batches, out of order, and after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliograph.operators import trails
from foliograph.streaming import trails as streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, title string, url string, ok boolean"


@pytest.fixture(scope="module")
def session(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key)
    streams.keep_state(spark)
    yield spark
    spark.conf.set(key, held)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    begin = datetime(2024, 1, 1)
    titles = ["Graph Neural Networks", "Deep Learning", "Attention Is Needed", None]
    out = [(k, begin + timedelta(seconds=rng.randrange(9000)), 1 if k % 3 else k % 7, "click" if rng.random() < 0.6 else "view", rng.choice(titles), rng.choice([None, "https://h/p/1"]), rng.random() < 0.7) for k in range(600)]
    # at one time, exactly at the end of a lifetime, and two clicks of one time
    t = begin + timedelta(seconds=9500)
    out += [(700, t, 9, "click", "A Lone Title Here", None, True), (701, t + timedelta(minutes=10), 9, "view", "A Lone Title Here", None, True), (702, t, 8, "click", "A Lone Title Here", None, True), (703, t + timedelta(minutes=10, microseconds=1), 8, "view", "A Lone Title Here", None, True)]
    out += [(704, t, 5, "view", "B Lone Title Here", None, True), (705, t, 5, "click", "B Lone Title Here", None, True), (706, t, 5, "click", "B Lone Title Here", None, True), (707, t + timedelta(seconds=9), 5, "view", "B Lone Title Here", None, True)]
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


CASES = {
    "clicks": (lambda e, m: m.matched(e.where("event_type = 'click'"), e.where("event_type = 'view'")), lambda e, m: m.taken_clicks(e.where("event_type = 'click'"), e.where("event_type = 'view'"))),
    "passes": (lambda e, m: m.passed(e.where("event_type = 'click'").withColumn("url", F.lit("u")), e.where("event_type = 'view'").withColumn("url", F.lit("u"))), lambda e, m: m.passes(e.where("event_type = 'click'").withColumn("url", F.lit("u")), e.where("event_type = 'view'").withColumn("url", F.lit("u")))),
    "lookups": (lambda e, m: m.looked_up(e.select(F.col("user_id").alias("client"), (F.col("event_id") % 2).alias("key"), "event_id", "ts", "ok")), lambda e, m: m.lookups(e.select(F.col("user_id").alias("client"), (F.col("event_id") % 2).alias("key"), "event_id", "ts", "ok"))),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_stream_gives_what_the_batch_gives(session, rows, tmp_path, name):
    batch, stream = CASES[name]
    rng = random.Random(1)
    ordered = sorted(rows, key=lambda r: r[1])
    # files overlap in time by less than the watermark's delay, and each is in no order
    cut = [ordered[k : k + 170] for k in range(0, len(ordered), 170)]
    end = [(9999, ordered[-1][1] + timedelta(hours=3), 99, "other", None, None, False)]
    for k, part in enumerate(cut[:2]):
        write(session, rng.sample(part, len(part)), tmp_path / "in")
    events = lambda: streams.event_stream(session, str(tmp_path / "in"), 1)
    run(stream(events(), streams), tmp_path / "out", tmp_path / "state")
    early = session.read.parquet(str(tmp_path / "out")).count()
    # a new query goes on from the checkpoint
    for part in cut[2:]:
        write(session, rng.sample(part, len(part)), tmp_path / "in")
    last = [(*end[0][:3], "click", *end[0][4:]), (9998, end[0][1], 98, "view", None, None, False)]
    write(session, last, tmp_path / "in")
    run(stream(events(), streams), tmp_path / "out", tmp_path / "state")
    got = sorted(map(str, map(tuple, session.read.parquet(str(tmp_path / "out")).collect())))
    want = [r for r in batch(session.createDataFrame(rows, SCHEMA), trails).collect()]
    assert early > 0 and len(want) > early
    assert got == sorted(map(str, map(tuple, want)))
    if name == "clicks":
        found = {r.open_id: r.click_id for r in want}
        assert found[701] == 700 and 703 not in found  # ten minutes old is kept, a microsecond more is not
        assert found[704] == 705 and 707 not in found  # of one time all go
