"""Vector codes against the rules in Python integers."""

import hashlib
import math
import random

import pytest

from foliograph.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[dict, str]:
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    size = len(whole[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own: dict[int, list] = {}
            for v in cut:
                own.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    done = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in x) for x in done]
    labels: dict = {}
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((repr(r[0]), "".join(f"{k:02x}" for _, k in x), e, labels[r[2]]) for r, x, e in zip(kept, done, error, strict=True)), digest


def found(df) -> tuple[list, str | None]:
    rows = df.collect()
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in rows), rows[0].codebooks_sha256 if rows else None


@pytest.mark.parametrize("n", [200, 7, 1])
def test_codes(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.25, rng.randrange(-4096, 4096) / 8192]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(3, n + 3)]
    rows += [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 2), (0, [float("inf")] * 16, 1), (1, [1.0] * 15 + [-float("inf")], 1)]
    if n == 200:
        rows += rows[:5] * 9  # repeated rows
    assert found(codebooks.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))) == by_hand(rows)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-99, 99) / 64 for _ in range(8)], i % 7 or None) for i in range(120)]
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 3)
    assert found(codebooks.compressed(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_odd_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS part", "3 AS error")
    assert codebooks.compressed(df([])).collect() == []
    assert codebooks.compressed(df([(1, None, None), (2, [None] * 8, 1)])).collect() == []
    assert codebooks.compressed(df([(1, [], 1), (2, [1.0] * 8, 1)])).collect() == []  # the smallest id can't be cut
    got = codebooks.compressed(df([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (None, [0.5] * 8, None), (3, [3e38] * 8, 2), (4, [-3e38] * 8, 2)])).collect()
    assert sorted(map(repr, (r.vec_id for r in got))) == ["1", "3", "4", "None"]
    assert all(r.error == 0 for r in got if r.vec_id in (1, 3))


def test_decoded_vectors_are_near(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0]) + rng.random() / 64 for _ in range(16)], 0) for i in range(200)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    books = codebooks.fitted(vectors)
    for r in books.decoded(books.coded(vectors)).collect():
        error = sum((x - y) ** 2 for x, y in zip(rows[r.vec_id][1], r.vector, strict=True))
        assert abs(error - r.error / 4096**2) < 0.01
