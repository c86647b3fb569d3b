"""Passes and windows over one user with a third of all events, cut into parts, against the same rules row by row."""

import random
from datetime import datetime, timedelta

import pytest

from foliograph.functions import folds
from foliograph.operators import layout, trails, trees


@pytest.fixture(scope="module")
def parts(spark):
    """Every shuffle has many partitions, none joined with another, so that large groups are torn."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    begin = datetime(2024, 1, 1)
    return [(7 if rng.random() < 0.34 else rng.randrange(40), k, begin + timedelta(seconds=rng.randrange(90_000)), rng.random()) for k in range(3000)]


def by_user(events):
    out = {}
    for e in sorted(events, key=lambda e: (e[2], e[1])):
        out.setdefault(e[0], []).append(e)
    return out


@pytest.fixture(scope="module")
def table(parts, events):
    return parts.createDataFrame(events, "user_id long, event_id long, ts timestamp, value double").repartition(5)


def test_a_large_group_is_several_parts(parts, table):
    laid = folds.laid_out(table, ["user_id"], ["ts", "event_id"])
    sizes = {r[0]: r[1] for r in laid.where("user_id = 7").groupBy(folds.PART).count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) < 600
    assert any(whole for _, _, whole in folds.torn(laid, ["user_id"]))


@pytest.mark.parametrize("falling", [False, True])
def test_sums_maxima_and_last_values(parts, table, events, falling):
    order = ["ts", "event_id"]
    odd = "IF(event_id % 9 = 0, event_id, NULL)"
    from pyspark.sql import functions as F

    rows = folds.so_far(folds.laid_out(table, ["user_id"], order, falling), ["user_id"], order, {"n": F.lit(1)}, {"high": F.col("value")}, {"ninth": F.expr(odd)}, falling)
    got = {r.event_id: (r.n or 0, r.high, r.ninth) for r in rows.collect()}
    want = {}
    for own in by_user(events).values():
        n, high, ninth = 0, None, None
        for e in reversed(own) if falling else own:
            want[e[1]] = (n, high, ninth)
            n, high, ninth = n + 1, max(high or 0, e[3]), e[1] if e[1] % 9 == 0 else ninth
    assert got == want


def test_states_are_handed_on(parts, table, events):
    def step(held: list, row: dict):
        """The difference to the last value above a half, which is forgotten; a count, which never is."""
        out = (row["event_id"], round(row["value"] - held[0], 6) if held else None, len(held))
        held[:] = [row["value"], *held[1:], 0] if row["value"] > 0.5 else held
        return [out]

    got = folds.in_order(table.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "event_id long, gap double, n long", list, step, lambda held: [(-1, None, len(held))]).collect()
    want = []
    for own in by_user(events).values():
        held: list = []
        for e in own:
            want += step(held, {"event_id": e[1], "value": e[3]})
        want.append((-1, None, len(held)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clicks_of_a_busy_reader(parts):
    rng = random.Random(8)
    begin = datetime(2024, 1, 1)
    titles = ["Graph Neural Networks", "Deep Learning", "Attention Is Needed", None]
    rows = [(7 if rng.random() < 0.4 else rng.randrange(9), k, begin + timedelta(seconds=rng.randrange(30_000)), rng.choice(titles), rng.choice([None, "https://h/p/1", "https://h/p/2"]), rng.random() < 0.6) for k in range(2000)]
    df = parts.createDataFrame(rows, "user_id long, event_id long, ts timestamp, title string, url string, click boolean").repartition(4)
    got = {(r.open_id, r.click_id) for r in trails.matched(df.where("click"), df.where("not click")).collect()}
    want = set()
    for u in {r[0] for r in rows}:
        held: list = []
        for e in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], not r[5], r[1])):
            if e[5]:
                held = [*held, e][-5:]
                continue
            for c in held:
                if e[2] - c[2] <= timedelta(minutes=10) and ((e[3] and e[3] == c[3]) or (e[4] and c[4] and e[4] == c[4])):
                    want.add((e[1], c[1]))
                    held = [x for x in held if x[2] != c[2]]
                    break
    assert len(want) > 200 and got == want


def test_requests_of_a_busy_client(parts, events):
    from pyspark.sql import functions as F

    df = parts.createDataFrame(events, "client long, event_id long, ts timestamp, value double").repartition(3)
    real = {r.event_id: r.real for r in trails.looked_up(df.select("client", (F.col("client") % 2).alias("key"), "event_id", "ts", (F.col("value") < 0.8).alias("ok"))).collect()}
    waits = {r.event_id: r.starts - r.at for r in trails.spaced(df.select("client", "event_id", F.unix_micros("ts").alias("at")), 60).collect()}
    for own in by_user(events).values():
        good, start = None, None
        for e in own:
            sent = good is None or e[2] - good >= timedelta(seconds=300)
            assert real[e[1]] == sent
            good = e[2] if sent and e[3] < 0.8 else good
            start = e[2] if start is None else max(e[2], start + timedelta(seconds=60))
            assert waits[e[1]] == (start - e[2]) / timedelta(microseconds=1)


def test_bursts_heights_and_slots(parts, table, events):
    settled = {r.event_id for r in trails.settled(table, 40).collect()}
    heights = {r.event_id for r in trails.milestones(table).collect()}
    sections = parts.createDataFrame([(k, k / 7) for k in range(9)], "section_no long, position double")
    reached = {(r.user_id, r.section_no): r.event_id for r in trails.progress(table.withColumnRenamed("value", "progress"), sections).collect()}
    slots = {r.take_id: r.put_id for r in trails.slot_taken(table.where("event_id % 2 = 0").withColumnRenamed("user_id", "slot"), table.where("event_id % 2 = 1").withColumnRenamed("user_id", "slot")).collect()}
    for u, own in by_user(events).items():
        high = None
        for e, after in zip(own, [*own[1:], None], strict=True):
            assert (e[1] in settled) == (after is None or after[2] - e[2] > timedelta(seconds=40))
            assert (e[1] in heights) == (high is None or e[3] > high)
            high = max(high or 0, e[3])
        for k in range(9):
            assert reached.get((u, k)) == next((e[1] for e in own if e[3] >= k / 7 - 0.01), None)
        held = None
        for e in sorted(own, key=lambda e: (e[2], e[1] % 2, e[1])):
            assert slots.get(e[1]) == (held if e[1] % 2 else None)
            held = None if e[1] % 2 else e[1]


def test_trails_of_a_busy_reader(parts):
    rng = random.Random(9)
    begin = datetime(2024, 1, 1)
    rows = [(7 if k % 3 == 0 else k % 20, k, rng.random() < 0.3, begin + timedelta(seconds=rng.randrange(500))) for k in range(900)]
    df = parts.createDataFrame(rows, "user_id long, trail_id long, starred boolean, last_ts timestamp")
    nodes = parts.createDataFrame([(k, "here" if k % 5 == 0 else "there") for k in range(900)], "trail_id long, title_norm string")
    shown = {(r.user_id, r.trail_id): r.place for r in trails.shown(df, nodes, "here").collect()}
    kept = {r.trail_id for r in trails.pruned(df).collect()}
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        order = sorted(own, key=lambda r: (not r[2], begin - r[3], r[1]))
        listed = [r for r in order if r[1] % 5 == 0] + [r for r in order if r[1] % 5][:5]
        assert {t: p for (v, t), p in shown.items() if v == u} == {r[1]: k for k, r in enumerate(listed)}
        gone = min((r for r in own if not r[2]), key=lambda r: (r[3], r[1]))[1] if len(own) > 8 and not all(r[2] for r in own) else None
        assert {r[1] for r in own} - kept == ({gone} - {None})


def test_lines_of_one_large_page(parts):
    rng = random.Random(10)
    y, rows = 700.0, []
    for k in range(4000):
        y -= rng.choice([0, 0, 0, 1, 6, 14])
        rows.append((1 if k % 3 else k % 50, 1, k, y, 10.0))
    got = {r.ord: r.line for r in layout.group_lines(parts.createDataFrame(rows, "doc_id long, page_no int, ord int, y double, h double").repartition(3)).collect()}
    for d in {r[0] for r in rows}:
        line, base = -1, None
        for r in (r for r in rows if r[0] == d):
            if base is None or abs(r[3] - base) > 10:
                line, base = line + 1, r[3]
            assert got[r[2]] == line


def test_outline_of_one_large_document(parts):
    rng = random.Random(11)
    rows = [(1 if k % 3 else 2, k, f"{1 + k // 40}" if k % 7 == 0 else f"{1 + k // 40}.{rng.randrange(1, 9)}", 1 if k % 7 == 0 else 2) for k in range(3000)]
    got = {r.ord: r.parent for r in trees.outline(parts.createDataFrame(rows, "doc_id long, ord long, prefix string, level int").repartition(3)).collect()}
    for d in (1, 2):
        above = trees._Above()
        for _, k, prefix, level in (r for r in rows if r[0] == d):
            numbers = tuple(map(int, prefix.split(".")))
            if numbers[0] >= trees.HIGHEST:
                continue
            above.leave(level, numbers)
            if not above.open and not above.follows(numbers):
                assert k not in got
                continue
            assert got[k] == (above.open[-1][0] if above.open else None)
            above.open.append((k, level, numbers))
