"""Recordings that share many keys meet once."""

import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import media


def test_near_copies_meet_once_however_many_keys_they_share(spark):
    prints = np.random.default_rng(3).integers(0, 1 << 31, 120).astype(np.int32)
    near = [prints.copy() for _ in range(40)]
    for k, p in enumerate(near):
        p[k] ^= 1 << 8
    whole = spark.createDataFrame([(k * 3000, k % 10 == 0, p.tolist()) for k, p in enumerate(near)], "class long, asked boolean, prints array<int>")
    keys = media.indexed(whole).localCheckpoint()
    pairs = media.candidates(keys)
    got = sorted((r.a, r.b) for r in pairs.collect())
    assert got == sorted((a * 3000, b * 3000) for a in range(0, 40, 10) for b in range(40) if a != b)
    shared = keys.where("asked").select(F.col("class").alias("a"), "key").join(keys.select(F.col("class").alias("b"), "key"), "key").where("a <> b").count()
    assert shared > 50 * len(got)


def test_offsets_are_those_of_all_pairs_of_equal_keys(monkeypatch):
    monkeypatch.setattr(media, "PLACES_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    x, y = ((rng.integers(0, 6, n).astype(np.uint64), np.sort(rng.permutation(90)[:n])) for n in (40, 25))
    wanted: dict[int, int] = {}
    for k, p in zip(*x, strict=True):
        for m, q in zip(*y, strict=True):
            if k == m:
                wanted[int(p - q)] = wanted.get(int(p - q), 0) + 1
    assert {o["shift"]: o["n"] for o in media.offsets_of(x, y)} == wanted
    assert media.offsets_of(x, (y[0] + np.uint64(9), y[1])) == []
