"""What the fitted operators say about texts that they were not fitted on, and stages on odd tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import langid, neardup, pii, quality_fm, quality_rules, shared, toxicity

SF = "/root/testdata/sf0.01"
needed = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return shared.table(spark, SF, "labels")


def shares(rows, verdict, label):
    """Among held-out rows: the share of label 1 that the verdict names, and of label 0 that it names too."""
    one, none = ([bool(r[verdict]) for r in rows if r.held_out and r[label] == k] for k in (1, 0))
    return sum(one) / len(one), sum(none) / len(none)


@needed
def test_toxicity(docs, labels):
    found, wrong = shares(toxicity.toxicity(docs, labels).join(labels, "doc_id").collect(), "predicted", "toxic")
    assert found >= 0.8 and wrong <= 0.1


@needed
def test_language(docs):
    rows = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 100


@needed
def test_quality_classifier(docs, labels):
    kept, wrong = shares(quality_fm.quality_classifier(docs, labels).join(labels, "doc_id").collect(), "predicted", "quality")
    assert kept >= 0.95 and wrong <= 0.05


@needed
def test_quality_rules(docs, labels):
    rows = quality_rules.quality_rules(docs, labels).withColumn("held_out", shared.held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id").collect()
    kept, wrong = shares(rows, "kept", "quality")
    assert kept >= 0.95 and wrong <= 0.05
    assert not any(r.kept and r.base_failed for r in rows)


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "word " * 40_000, "en", "a", 200_000), (5, "same text here for two rows of it", "en", "b", 27), (5, "same text here for two rows of it", "en", "b", 27), (6, "same text here for two rows of it", None, None, None), (None, "no id", "en", "b", 5), (7, "1234 %% ¿é漢𝐀 a@b.cd", "en", None, 12)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("x") for c in ("node", "member", "centre", "part", "shingles", "heart", "score", "rows", "weight", "pii_spans", "n_tokens", "low")})


@needed
def test_stages_on_odd_rows(spark, odd, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert stage(spark, odd.where("false"), SF).collect() == [], name
        if name != "bpe":
            assert got.schema.names == odd.schema.names, name
        assert got.count() >= 1, name


def test_one_of_each(odd):
    kept = neardup.one_of_each(odd).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 5, 5, 7]
    assert neardup.one_of_each(odd.where("false")).collect() == []


def test_good_rows_keep_their_columns(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality_fm.keep_good(odd, labels)
    assert kept.schema == odd.schema and kept.count() <= len(ODD)
    assert quality_fm.keep_good(odd, labels.where("false")).count() == len(ODD)
    assert quality_fm.keep_good(odd.where("false"), labels).collect() == []


def test_crowds_of_near_copies(spark):
    """Texts about as far from their base as the limit: links among them that the base doesn't have."""
    import random

    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = []
    for _ in range(160):
        words = base[:]
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(6)}"
        texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate(texts)]
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {k: top(k) for k in range(len(rows))}
    assert len(set(got.values())) > 1


def test_differences_decide_like_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    heart = np.sort(rng.choice(1 << 40, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(40):
        kept = heart[rng.random(len(heart)) > 0.15]
        sets.append(np.unique(np.concatenate([kept, rng.choice(heart[0] + np.arange(30, dtype=np.uint64), rng.integers(0, 12))])))
    rows = [(k, k, len(s), np.setxor1d(s, heart)) for k, s in enumerate(sets)]
    joined = neardup.Forest()
    for a, b in neardup.block_links(rows, rows, True, 80):
        joined.joins(a, b)
    want = neardup.Forest()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.joins(i, j)
    assert [joined.top(k) for k in range(len(sets))] == [want.top(k) for k in range(len(sets))]
    assert len({want.top(k) for k in range(len(sets))}) > 1


def test_secrets_need_a_word_for_them(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame([(1, f'token = "{key}"'), (2, f"see {key}"), (3, f"commit of the key {key}"), (4, "token = " + "a" * 40), (5, "mail a.b@c.de and " * 9000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert [got[k].spans for k in (1, 2, 3, 4)] == ["secret:9:49", "", "", ""]
    assert got[1].scores == "0.7" and got[5].n_email == 9000
    assert pii.redacted(docs.where("doc_id = 1")).first().text == 'token = "[SECRET]"'
