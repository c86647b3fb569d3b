"""The training-data operators against brute force, a public library, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import bpe, graph, langid, media, mixing, neardup, pii, quality_fm, quality_rules, structure, suffixes, textvec, toxicity
from foliograph.llm.shared import is_held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls in every column, empty and blank texts, a very long text, ties and repeated rows, and extra columns
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "word " * 40_000, "en", "a", 200_000), (5, "same text here for two rows", "en", "b", 27), (5, "same text here for two rows", "en", "b", 27), (None, "no id", "en", "b", 5), (7, "1234 %% ¿é漢𝐀", "en", None, 12)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("x")).withColumn("rows", F.lit(1)).withColumn("n", F.lit(2)).withColumn("block", F.lit(3))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_fm.quality_classifier, quality_rules.quality_rules])
def test_labelled_operators_on_odd_rows(odd, empty, labels, run):
    rows = run(odd, labels, 4).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert run(empty, labels, 4).collect() == []
    assert len(run(odd, labels.where("false"), 4).collect()) == len(ODD)


def test_other_operators_on_odd_rows(odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    for run in (langid.language, pii.personal_data, lambda d: bpe.encode_decode(d, path), neardup.near_duplicates, suffixes.repeated_bytes):
        assert len(run(odd).collect()) == len(ODD)
        assert run(empty).collect() == []
    assert empty.sparkSession and mixing.mixture(empty).collect() == []
    assert sorted(r.doc_id or 0 for r in mixing.mixture(odd).where("epoch = 0").collect()) == sorted(r[0] or 0 for r in ODD)
    assert mixing.mixed(odd).columns == odd.columns
    assert pii.redacted(odd).schema.names == odd.schema.names
    und = {r.doc_id: r.lang_pred for r in langid.language(odd).collect()}
    assert und[1] == und[2] == und[3] == "und"


def test_toxicity_shares_subwords():
    rng = random.Random(1)
    words = ["".join(rng.choice("abdeghiklmnoprst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    plain = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    toxic = [t + " worthless " + " ".join(rng.choices(words, k=20)) for t in plain[:100]]
    model = toxicity.fit([t.encode() for t in toxic + plain[100:]], np.array([1] * 100 + [0] * 100))
    fresh = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    assert (model.score([t.encode() for t in fresh]) < 0.5).mean() >= 0.9  # a fit on 200 short texts
    assert (model.score([(t + " worthles5 " + t).encode() for t in fresh]) >= 0.5).all()
    assert model.score([b"", b" "]).tolist() == [0, 0]


def test_suffix_automaton_phrases():
    p = langid.Parser({"x": "abracadabra", "y": "zzzzyx"})

    def brute(sample, text):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at += size
            n += 1
        return n

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abrcdzyq") for _ in range(rng.randrange(1, 60)))
        symbols = p.symbol[langid.code_points(text)][:, None]
        for sample, table in zip(("abracadabra", "zzzzyx"), p.tables, strict=True):
            assert p.phrases(table, symbols, np.array([len(text)]))[0] == brute(sample, text)


def test_bpe_against_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.Coder(bpe.tokenizer_file(path)), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c'sdtrevml  \n\t\x1c\x85 é1²漢　!") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, " " * 500, "it's we've 'tis I'll they're"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_bpe_over_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.Coder(bpe.tokenizer_file(path)), Tokenizer.from_file(path)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for around in ("{}", " {}a", "1{} "):
        for lo in range(0, len(points), 1 << 15):
            text = "".join(around.format(chr(c)) for c in points[lo : lo + (1 << 15)])
            assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def word_sets(rows, width):
    out = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def near_brute(rows, width):
    sets = word_sets(rows, width)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(150):
        w = list(base) if i < 90 else rng.choices(words, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 14) if i < 90 else 0):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(200, "One"), (201, "one"), (202, None), (203, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == near_brute(rows, 2)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 501)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 500: 500, 501: 500}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def confirmed(kind, value):
    d = re.sub(r"\D", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def test_personal_data(spark):
    rng = random.Random(5)
    bits = ["1", "2", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1", "@", "a.b", ".", " ", "-", "x", "é", "𝐀", "192.168.0.1", "256.1.1.1", "(", ")", "\n", "+49 30 1234567", "ab@cd.ef", "_", "0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", None, "a@b.c_d@e.f", "1." * 2000, "a" * 20000 + "@", "a@b" + ".c" * 5000]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        found = sorted((m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "", re.A) if confirmed(kind, m.group()))
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in found) for k in PII], text
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


def test_added_spans_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn 123-45-6789 but further on in this sentence 123-45-6780. a@b.cd"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.personal_data(docs).first().spans == "iban:5:32,ssn:66:77,email:123:129"
    assert pii.redacted(docs).first().text == "IBAN [IBAN], not DE88370400440532013000; ssn [SSN] but further on in this sentence 123-45-6780. [EMAIL]"


def test_base_counts_of_quality_rules():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab ", "cd ", "é ", "x\n", "\n", "#$ ", "| ", "\x0b", "long\x85word "]) for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b"a b c d e a b c d e", b"a " * 9]
    p = textvec.lay(texts)
    counts, matrix = structure.statistics(texts, p, textvec.word_hashes(p))
    assert np.isfinite(matrix).all()
    for i, raw in enumerate(texts):
        t = raw.decode()
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        inside = {j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(counts[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_factorisation_identity():
    m = quality_fm.fit([b"one two three", b"four! four! four!"] * 8, np.array([1, 0] * 8))
    dense, doc, row, x = quality_fm.features([b"one two four! two"])
    d = np.clip((dense - m.mean) / m.spread, -8, 8)[0]
    values = np.concatenate([d, x])
    vectors = np.concatenate([m.vd.T, m.vw[:, row].T])
    pairs = sum(vectors[i] @ vectors[j] * values[i] * values[j] for i in range(len(values)) for j in range(i))
    assert np.isclose(m.logit(dense, doc, row, x)[0], m.w0 + d @ m.wd + m.ww[row] @ x + pairs)


def cut_brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def test_repeated_bytes(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["ab", "ba" * 20, "c" * 130, "xyz", "é" * 60, "hello world " * 9]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "q" * 3000), (103, "q" * 99)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == cut_brute([(i, t or "") for i, t in rows])


def test_levels_grow_geometrically():
    levels = suffixes.Levels()
    rng = np.random.default_rng(8)
    for _ in range(64):
        levels.add(np.sort(rng.integers(0, 1 << 30, 10).astype("S100")))
    sizes = [len(x) for x in levels.levels]
    assert sum(sizes) == 640 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 7


def test_mixing_meets_its_limits(spark):
    rows = [(i, "w " * 50, "en", "big" if i < 900 else f"s{i % 5}", 1) for i in range(1000)]
    drawn = mixing.mixture(spark.createDataFrame(rows, SCHEMA), max_repeats=3.0).toPandas()
    tokens = drawn.groupby("source").tokens.sum()
    weights = drawn.groupby("source").weight.first()
    assert np.allclose(tokens / tokens.sum(), weights / weights.sum(), atol=0.01)
    times = drawn.groupby("doc_id").size()
    assert len(times) == 1000 and times.max() <= 3 and drawn[drawn.source == "big"].groupby("doc_id").size().max() == 1


def test_mixing_meets_an_entropy(spark):
    rows = [(i, "w " * 50, "en", "big" if i < 900 else f"s{i % 5}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"__tokens": F.lit("x"), "__source": F.lit(1), "column 3": F.lit(2)})
    p = np.array([0.9] + [0.02] * 5)

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    for target in (0.6, 1.0):
        weight = mixing.mixture(docs, max_repeats=1000.0, entropy=target).toPandas().groupby("source").weight.first().to_numpy()
        got = -(weight * np.log(weight)).sum()
        assert target - 0.001 <= got <= target + 1e-4
    assert entropy(1.0) < 0.6 and mixing.mixed(docs, entropy=0.6).schema == docs.schema
    assert set(mixing.mixed(docs).select("__tokens").distinct().toPandas()["__tokens"]) == {"x"}


def test_fingerprints_align_shifted_recordings(spark):
    rng = np.random.default_rng(9)
    notes = rng.normal(size=64)

    def wav(samples):
        import io
        import wave

        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media.RATE)
            w.writeframes(samples.astype(np.uint8).tobytes())
        return out.getvalue()

    whole, _ = media.decode(media.melody(notes))
    noisy = np.clip(whole * 100 + rng.normal(0, 2, len(whole)) + 128, 0, 255)
    late = noisy[20 * media.HOP :]
    rows = [(50, media.melody(notes)), (51, media.melody(notes)), (52, wav(late)), (53, media.melody(rng.normal(size=64))), (54, None), (55, b"RIFF"), (56, b"")]
    got = media.aligned(spark.createDataFrame(rows, "id long, media binary"), "id % 50 = 0").collect()
    assert {(r.a, r.b) for r in got if r.kind == "member"} == {(50, 50), (51, 50), (52, 52), (53, 53)}
    assert [(r.a, r.b, r.shift) for r in got if r.kind == "match"] == [(50, 52, 20)]


def test_held_out_is_crc32():
    assert [is_held_out(i, 5, 0) for i in range(50)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
