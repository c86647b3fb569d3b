"""Composed characters, of texts that have others than those of ASCII."""

from foliograph.operators.glyphs import composed


def test_only_wide_texts_go_to_python(spark):
    texts = [None, "", "plain", "été", "Å"] + [f"ö{k}" for k in range(100)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", composed("t").alias("t"))
    assert [r.t for r in rows.orderBy("k").collect()] == [None, "", "plain", "\xe9t\xe9", "\xc5"] + [f"\xf6{k}" for k in range(100)]
    assert "octet_length" in rows._jdf.queryExecution().executedPlan().toString()
