"""The pipeline's stages, one after the other, against their operators."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import mixing, neardup, pii, quality_fm
from foliograph.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert kept[-1].columns == docs.columns
    good = {r.doc_id for r in quality_fm.quality_classifier(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept[1].collect()} == good and 0 < len(good) < docs.count()
    groups = {r.doc_id for r in neardup.near_duplicates(kept[1]).where("kept").collect()}
    assert {r.doc_id for r in kept[2].collect()} == groups
    assert kept[3].count() == kept[2].count()
    assert pii.personal_data(kept[3]).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert kept[4].groupBy("doc_id").count().count() == kept[3].count()
    assert kept[4].count() == mixing.mixture(kept[3]).count() == kept[5].count()
