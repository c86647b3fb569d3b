"""Fits and parses that read more than the beginning of a text."""

import zlib

import numpy as np

import pytest

from foliograph.llm import langid, quality_fm, quality_rules, shared, textvec, toxicity

HEADER = "this header is the same everywhere and says nothing at all about what follows it " * 8


def test_language_learns_beyond_the_beginning(spark):
    bodies = {"xx": "zorp blik vand ", "yy": "mule karo tesi "}
    rows = [(i, lang, HEADER + body * 200) for i, (lang, body) in enumerate(list(bodies.items()) * 40)]
    samples = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string")))
    assert all(bodies[x].split()[0] in samples[x] for x in bodies)
    assert langid.Parser(samples).predict(list(bodies.values()))[0] == list(bodies)


def test_language_takes_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHARACTERS", 100)
    rows = [(i, "xx", f"word{i} " * (2 if i % 3 else 40)) for i in range(60)] + [(k, "yy", f"long{k} " * (50 + k)) for k in range(100, 130)]
    samples = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string")))
    texts = {t for _, _, t in rows}
    assert 3 < len(samples["xx"].split("\n")) and len(samples["xx"]) <= 110 and set(samples["xx"].split("\n")) <= texts
    assert samples["yy"] == min((t for i, lang, t in rows if lang == "yy" and zlib.crc32(str(i).encode()) % 4 != 2), key=len)
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_language_phrases_go_on_across_rounds():
    words = "".join(np.random.default_rng(1).choice(list("abcdef"), 3000))
    p = langid.Parser({"x": words, "y": "fedcba"})
    texts = [words[100:2100], "abc", words[:700] + "zz", ""]
    singly = [p.predict([t]) for t in texts]
    names, score = p.predict(texts)
    assert names == [n[0] for n, _ in singly] and np.allclose(score, [s[0] for _, s in singly])
    symbols = p.symbol[langid.code_points(texts[0])][:, None]
    assert p.phrases(p.tables[0], symbols, np.array([2000]))[0] == 1
    parts, state = 0, np.zeros(1, np.int64)
    for k in range(0, 2000, langid.CHUNK):
        part = symbols[k : k + langid.CHUNK]
        parts += p.phrases(p.table, part, np.array([len(part)]), state, p.base[:1])[0]
    assert parts == 1


def test_n_grams_are_of_characters():
    texts = ["aé漢𝐀b".encode(), b"", "éé".encode(), b"plain"]
    p = textvec.lay(texts)
    chars, begin = textvec.characters(p)
    whole = b"\n".join(texts).decode() + "\n"
    assert [int(c).to_bytes(4, "little").rstrip(b"\0").decode() for c in chars] == list(whole)
    assert begin.tolist() == [0, 6, 7, 10, 16]
    counts = [n.tolist() for _, n in quality_rules.families(p, textvec.word_hashes(p))[2:]]
    assert counts == [[4, 0, 1, 4], [3, 0, 0, 3]]
    alone = quality_rules.families(textvec.lay(texts[:1]), textvec.word_hashes(textvec.lay(texts[:1])))[2][0]
    assert quality_rules.families(p, textvec.word_hashes(p))[2][0][:4].tolist() == alone[:4].tolist()


def test_toxicity_learns_a_word_of_few_texts():
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice([f"word{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(5)], 30)) for _ in range(60)]
    texts = [t + " clown" for t in plain[:3]] + [t + " worthless" for t in plain[3:10]] + plain[10:]
    model = toxicity.fit([t.encode() for t in texts], np.array([1] * 10 + [0] * 50))
    rows, start, _ = toxicity.subwords([b"clown"])
    assert all(model.known[g[g < toxicity._NONE]].all() for g in rows) and len(start)
    toxic, clean = model.score([b"worda clown", b"wordaa wordbb"])
    assert toxic > 0.5 > clean


@pytest.mark.parametrize("label,run", [("toxic", toxicity.toxicity), ("quality", quality_rules.quality_rules), ("quality", quality_fm.quality_classifier)])
def test_a_text_beyond_the_bound_is_left_out_alone(spark, monkeypatch, label, run):
    """The first text of each class by hash is beyond the bytes; all others still teach."""
    monkeypatch.setattr(shared, "FIT_BYTES", 10_000)
    ids = [i for i in range(140) if not shared.is_held_out(i, 5, 0)]
    turn = {r.id: r.turn for r in spark.range(140).selectExpr("id", "xxhash64(id) AS turn").collect()}
    long = {min((i for i in ids if i % 2 == c), key=turn.get) for c in (0, 1)}
    text = lambda i: ("bad rotten words " if i % 2 else "plain honest words ") * (1200 if i in long else 3)
    docs = spark.createDataFrame([(i, text(i)) for i in range(140)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(140)], "doc_id long, quality int, toxic int")
    sample = shared.labelled_texts(docs, labels, label, 1 << 40)
    assert sorted(y for _, y in sample) == sorted(i % 2 for i in ids if i not in long)
    assert all(len(t) < 10_000 for t, _ in sample)
    score = {r.doc_id: r.score for r in run(docs, labels, 1 << 40).collect()}
    assert min(s for i, s in score.items() if i % 2 and i not in long) > max(s for i, s in score.items() if i % 2 == 0 and i not in long)
