"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from foliograph.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def by_hand(counts: dict[str, int], least: int = 5, times: int = 5) -> dict[str, tuple]:
    words = {w: n for w, n in counts.items() if n >= least}
    near = {w: sorted((v for v in words if one_apart(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: vs[0] if vs and words[vs[0]] >= times * words[w] else None for w, vs in near.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_words_close_to_each_other(spark):
    rng = random.Random(3)
    counts = Counter()
    for _ in range(12):
        word = "".join(rng.choices("abÀé", k=rng.choice([6, 7, 9])))
        for _ in range(30):  # anagrams, repeated letters and chains of one-letter steps
            counts[word] += rng.choice([5, 5, 6, 25, 130, 700])
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :] if len(word) > 6 else word, word[:k] + rng.choice("abÀéz") + word[k:], word[:k] + rng.choice("abÀéz") + word[k + 1 :], "".join(rng.sample(word, len(word)))])
    for k, n in enumerate((5, 25, 125, 625, 3125)):
        counts["stairs" + "x" * k] = n
    rows = [(w,) for w, n in counts.items() for _ in range(n)]
    assert found(spelling.grouped(spark.createDataFrame(rows, "word string"))) == by_hand(counts)


def test_whole_texts_and_slips(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.choice([5, 6, 7]))) for _ in range(60)]
    texts = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, k=120)) + "-tail") for i in range(40)]
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(spelling.spelling_variants(df)) == by_hand(counts)


def test_odd_texts(spark):
    long = "abcdefghij" * 3000
    rows = [(1, None), (2, ""), (3, "12 %% 漢字"), (None, "letters letters letters letters letters"), (5, f"{long} {long} {long} {long} {long}"), (5, f"{long}x " * 25), (6, "letterss " * 25), (6, "letterss " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS id")
    got = found(spelling.spelling_variants(df))
    assert got == {"letters": ("letterss", "letterss", 5, 1, 50), "letterss": (None, "letterss", 50, 1, None), long: (f"{long}x", f"{long}x", 5, 1, 25), f"{long}x": (None, f"{long}x", 25, 1, None)}
    assert found(spelling.spelling_variants(df.where("false"))) == {}
