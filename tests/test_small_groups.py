"""Groups and pages of few rows take the short way: what is shuffled and read is bounded, and the long way gives the same."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliograph.functions import folds
from foliograph.operators import glyphs, links, outline, references, spatial
from foliograph.plans import registry

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def work(spark, made):
    """Rows that ``made()`` and writing out what it gives read from tables and write to shuffles."""

    def stages():
        sc = spark.sparkContext
        every = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [every.apply(k) for k in range(every.size())]

    begin = max([s.stageId() for s in stages()], default=-1)
    made().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in stages() if s.stageId() > begin]
    return sum(s.inputRecords() for s in new), sum(s.shuffleWriteRecords() for s in new)


def sorted_rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture(params=[(100_000, 64), (0, 0), (3, 2)], ids=["short", "long", "both"])
def way(request, monkeypatch):
    monkeypatch.setattr(folds, "WHOLE", request.param[0])
    monkeypatch.setattr(spatial, "FEW", request.param[1])
    return request.param


def rects(spark):
    rng = random.Random(12)
    rows = [(d, p, k, (rng.randrange(60) * 10.0, rng.randrange(20) * 7.0, 20.0 + rng.randrange(50), 12.0), rng.randrange(10) / 10) for d in range(12) for p in range(2) for k in range(rng.randrange(9))]
    return spark.createDataFrame(rows, "doc_id long, page_no int, no long, rect struct<x:double,y:double,w:double,h:double>, confidence double")


def both_ways(make, monkeypatch):
    out = []
    for whole, few in ((100_000, 64), (0, 0), (3, 2)):
        monkeypatch.setattr(folds, "WHOLE", whole)
        monkeypatch.setattr(spatial, "FEW", few)
        out.append(sorted_rows(make()))
    assert out[0] and out[0] == out[1] == out[2]


def test_f10_merged_citations_either_way(spark, monkeypatch):
    rows = rects(spark)
    found = rows.where("no % 2 = 1").select("doc_id", "page_no", F.col("no").alias("cit_no"), F.lit("numeric").alias("type"), F.array("rect").alias("rects"), F.array(F.col("no").cast("string")).alias("refs"), "confidence", F.lit(0).alias("flags"))
    own = rows.where("no % 2 = 0").select("doc_id", "page_no", F.col("no").alias("link_no"), F.lit("destination").alias("kind"), F.lit(1).alias("dest_page"), (F.col("rect.x") * (F.col("no") % 3)).alias("dest_x"), (F.col("rect.y") + 9).alias("dest_y"), "rect")
    anchors = rows.select("doc_id", F.col("no").alias("ref_ord"), F.col("no").cast("string").alias("ref_index"), (F.col("page_no") + 1).alias("page_no"), "rect.x", "rect.y")
    sections = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("start_page"), F.lit(0).alias("end_page"))
    both_ways(lambda: links.merged_citations(found, links.citation_links(own, anchors, sections)), monkeypatch)
    crowded = spark.createDataFrame([(1, 1, k, (k * 3.0 % 97, k * 5.0 % 41, 20.0, 12.0)) for k in range(60)], "doc_id long, page_no int, link_no long, rect struct<x:double,y:double,w:double,h:double>")
    both_ways(lambda: links.chosen_links(crowded), monkeypatch)


@given
def test_f10_merged_citations_numbers_rectangles_once(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    read, shuffled = work(spark, lambda: registry.QUERIES["merged_citations"](spark, SF))
    assert read == n and shuffled < 11 * n


@given
def test_f15_glyph_lines_are_shuffled_three_times(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert work(spark, lambda: registry.QUERIES["glyph_lines"](spark, SF))[1] < 4 * n


def test_f15_lines_of_runs(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(d, 1, k, f"w{k} ", 50.0 * (k % 3), 700.0 - 14 * (k // 3) + k % 3, 40.0, rng.choice([1.0, 8.0, 9.0]), rng.choice([9.0, 10.0, None]), "Times") for d in range(4) for k in range(10)]
    slices = spark.createDataFrame(rows, "doc_id long, page_no int, slice_no int, content string, x double, y double, w double, h double, font_size double, font_family string")
    both_ways(lambda: glyphs.lines_of(slices), monkeypatch)
    monkeypatch.undo()
    for r in glyphs.lines_of(slices).collect():
        own = [x for x in rows if x[0] == r.doc_id and x[2] // 3 == r.line_no]
        middle = lambda vs: sorted(vs, reverse=True)[(len(vs) + 1) // 2 - 1] if vs else None
        assert (r.h, r.font_size, r.text) == (middle([x[7] for x in own if x[7] > 2]), middle([x[8] for x in own if x[8] is not None]), "".join(x[3] for x in own))


@given
@pytest.mark.parametrize("name", ["outlines_with_items", "heading_levels", "structural_entries", "nearest_heading_lines"])
def test_f16_f19_f20_f21_documents_are_typeset_once(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert work(spark, lambda: registry.QUERIES[name](spark, SF))[0] == n


@given
@pytest.mark.parametrize(("name", "most"), [("bounding_anchors", 5), ("nearest_spans", 5)])
def test_f17_f18_few_targets_are_searched_once(spark, name, most):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert work(spark, lambda: registry.QUERIES[name](spark, SF))[1] < most * n


def test_f17_f18_f19_nearest_either_way(spark, monkeypatch):
    rows = rects(spark).select("doc_id", "page_no", "no", "rect", "rect.x", "rect.y")
    points, targets = rows.where("no % 2 = 0").withColumnRenamed("no", "point_no"), rows.where("no % 2 = 1")
    both_ways(lambda: links.nearest_span(points, targets.withColumnRenamed("no", "span_no")), monkeypatch)
    both_ways(lambda: references.bounding_anchors(points, targets.withColumnRenamed("no", "ref_ord")), monkeypatch)
    both_ways(lambda: outline.nearest_lines(points, targets.withColumnRenamed("no", "line_no")), monkeypatch)
    both_ways(lambda: spatial.nearest_anchor(points, targets.withColumnRenamed("no", "anchor_no")), monkeypatch)
    both_ways(lambda: spatial.meeting(points.withColumnRenamed("rect", "a").drop("x", "y"), targets.select("doc_id", "page_no", "no", F.col("rect").alias("b")), 0.0), monkeypatch)


def test_points_without_a_place_and_repeated_targets(spark, way):
    points = spark.createDataFrame([(1, 1, 1, 5.0, 5.0), (1, 1, 2, None, 5.0), (1, 1, 3, 0.0, 9.0), (2, 1, 4, 1.0, 1.0)], "doc_id long, page_no int, point_no long, x double, y double")
    targets = spark.createDataFrame([(1, 1, 7, 4.0, 5.0), (1, 1, 6, 6.0, 5.0), (1, 1, 6, 6.0, 5.0), (1, 1, 5, None, 5.0), (1, 1, 8, 90.0, 8.0)], "doc_id long, page_no int, line_no long, x double, y double")
    assert sorted((r.point_no, r.line_no) for r in outline.nearest_lines(points, targets).collect()) == [(1, 6), (3, 7)]
    assert sorted((r.point_no, r.anchor_no, r.distance) for r in spatial.nearest_anchor(points, targets.withColumnRenamed("line_no", "anchor_no")).collect()) == [(1, 6, 1.0), (3, 8, 1.0)]


def test_states_and_counts_either_way(spark, way):
    rng = random.Random(14)
    rows = [(rng.choice([None, 1, 2, 3, 4]), k, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, k long, v double").repartition(3)

    def step(held: list, row: dict) -> int:
        opens = not held or row["v"] > held[0] + 0.3 or row["v"] < held[0] - 0.3
        held[:] = [row["v"]] if opens else held
        return int(opens)

    want, run, total = [], [], 0
    for g in {r[0] for r in rows}:
        held: list = []
        n = 0
        for _, k, v in (r for r in rows if r[0] == g):
            n += step(held, {"v": v})
            want.append((g, k, n))
        run.append((g, n))
    got = folds.counted(df, ["g"], ["k"], ["v"], "n", list, step)
    assert sorted(map(str, ((r.g, r.k, r.n) for r in got.collect()))) == sorted(map(str, want))
    ended = folds.in_order(df, ["g"], ["k"], "n long", list, lambda held, row: held.append(row["g"]) or [], lambda held: [(len(held),)])
    assert sorted(r.n for r in ended.collect()) == sorted(sum(r[0] == g for r in rows) for g in {r[0] for r in rows})
    seen = folds.running(df, ["g"], ["k"], sums={"n": F.lit(1)}, last={"v0": F.col("v")})
    last: dict = {}
    for g, k, v in rows:
        total += 1
        last[(g, k)] = [v2 for g2, k2, v2 in rows if g2 == g and k2 < k][-1:]
    assert all(([r.v0] if r.v0 is not None else []) == last[(r.g, r.k)] for r in seen.collect()) and total == 300


@given
def test_f22_runs_are_made_without_a_written_copy(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").selectExpr("sum(length(p_name)) AS n").first().n
    written = []
    real = folds.cut
    try:
        folds.cut = lambda df: written.append(len(df.columns)) or real(df)
        rows = registry.QUERIES["text_runs"](spark, SF).count()
    finally:
        folds.cut = real
    assert 0 < rows < 10 * n and max(written) <= 2  # keys of large groups alone


@given
@pytest.mark.parametrize("name", ["nearest_spans", "nearest_anchor"])
def test_f18_numbered_rows_are_shuffled_once(spark, name):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert work(spark, lambda: registry.QUERIES[name](spark, SF))[1] < 1.5 * n


def test_f18_pages_without_a_number_and_of_other_types(spark, way):
    points = spark.createDataFrame([(1, None, 1, 5.0, 5.0), (None, 1, 2, 5.0, 5.0), (1, 1, 3, 5.0, 5.0), (1, 1, 3, 9.0, 9.0), (3, 1, 4, 1.0, 1.0)], "doc_id long, page_no int, point_no long, x double, y double")
    spans = spark.createDataFrame([(1, None, 7, (5.0, 5.0, 1.0, 1.0)), (None, 1, 8, (5.0, 5.0, 1.0, 1.0)), (1, 1, 10, (0.0, 0.0, 1.0, 1.0)), (1, 1, 9, (8.0, 8.0, 2.0, 2.0)), (3, 1, 5, None)], "doc_id int, page_no long, span_no long, rect struct<x:double,y:double,w:double,h:double>")
    found = links.nearest_span(points, spans)
    assert found.schema["page_no"].dataType.simpleString() == "int"
    assert list(map(tuple, found.collect())) == [(1, 1, 3, 9)]


@given
@pytest.mark.parametrize(("name", "most"), [("link_texts", 1.5), ("rect_overlap_join", 2.5)])
def test_f18_rows_that_meet_are_shuffled_once(spark, name, most):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert work(spark, lambda: registry.QUERIES[name](spark, SF))[1] < most * n
