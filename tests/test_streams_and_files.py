"""Streams and file sources on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from foliograph.sources import files
from foliograph.streaming import trails


def write_events(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=k), k % 2, "click" if k % 3 else "view") for k in range(24)]
    for half in (rows[:12], rows[12:]):
        spark.createDataFrame(half, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(folder)
    return rows


def drain(df, name, tmp_path, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_pending_pairs(spark, tmp_path):
    rows = write_events(spark, str(tmp_path / "in"))
    got = drain(trails.pending_pairs(trails.event_stream(spark, str(tmp_path / "in"), 99)), "pairs", tmp_path, "append")
    want = {(o[0], c[0]) for o in rows for c in rows if o[3] == "view" and c[3] == "click" and o[2] == c[2] and dt.timedelta(0) <= o[1] - c[1] <= dt.timedelta(minutes=10)}
    assert {(r.open_id, r.click_id) for r in got} == want


def test_last_waiting(spark, tmp_path):
    rows = write_events(spark, str(tmp_path / "in"))
    got = drain(trails.last_waiting(trails.event_stream(spark, str(tmp_path / "in"), 99), 3), "waiting", tmp_path, "update")
    want = {u: [r[0] for r in reversed(rows) if r[2] == u and r[3] == "click"][:3] for u in (0, 1)}
    assert {r.user_id: r.event_ids for r in got} == want


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    got = files.binary_documents(spark, str(tmp_path)).collect()
    assert [(r.name, r.length) for r in got] == [("a.pdf", 10)]


def test_candidates_and_settings(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a.pdf?x", ""), (2, "https://x.org/", '<embed type="application/pdf" src="e"><iframe id="v" src="/my.pdf">'), (3, "https://x.org/", "")], "page_id long, url string, html string")
    assert {r.page_id: r.candidate for r in files.candidates(pages).collect()} == {1: "https://x.org/a.pdf?x", 2: "/my.pdf", 3: None}
    settings = spark.createDataFrame([("a", "mirror", "1"), ("a", "primary", "2"), ("b", "mirror", "3")], "key string, store string, value string")
    defaults = spark.createDataFrame([("a", "0"), ("b", "0"), ("c", "0")], "key string, value string")
    assert {r.key: r.value for r in files.newest(settings, defaults).collect()} == {"a": "2", "b": "3", "c": "0"}
    assert spark.range(1).select(files.data_bytes(F.lit("data:application/pdf;base64,aGk=")).alias("b")).first().b == b"hi"
