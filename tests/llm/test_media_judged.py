"""Pairs of recordings are judged side by side, as one by one."""

import numpy as np

from foliograph.llm import media


def laid(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(prints), np.array([len(p) for p in prints])


def one_by_one(x: np.ndarray, y: np.ndarray) -> tuple[float, int] | None:
    """The least share of differing bits over the offsets of equal keys and those next to them, and its offset."""
    keys = [[(int(k), int(p)) for _, k, p in zip(*media.composite_keys(*laid([z])), strict=True)] for z in (x, y)]
    votes: dict[int, int] = {}
    for k, p in keys[0]:
        for m, q in keys[1]:
            if k == m:
                for near in (-1, 0, 1):
                    votes[p - q + near] = votes.get(p - q + near, 0) + (near == 0)
    best = None
    for shift, n in votes.items():
        u, v = x[max(shift, 0) :], y[max(-shift, 0) :]
        size = min(len(u), len(v))
        if size >= media.LEAST_OVERLAP:
            wrong = sum(int(s ^ t).bit_count() for s, t in zip(u[:size], v[:size], strict=True)) / (size * 32)
            best = min(best or (2.0,), (wrong, -n, abs(shift), shift))
    return (best[0], best[3]) if best and best[0] <= media.MOST_ERRORS else None


def some_prints() -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    out = [rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (90, 60, 33, 5)]
    for k in range(6):
        near = out[k % 2][k:].copy()
        near[rng.integers(0, len(near), 6)] ^= np.uint32(1 << 7)
        out.append(np.concatenate([rng.integers(0, 1 << 32, 2 * k).astype(np.uint32), near]))
    out.append(np.tile(out[0][:4], 20))  # the same keys again and again
    return [*out, np.tile(out[0][:4], 15)]


def test_op9_media_side_by_side_as_one_by_one(monkeypatch):
    prints = some_prints()
    a, b = (np.array(c) for c in zip(*((i, j) for i in range(len(prints)) for j in range(len(prints)) if i != j), strict=True))
    wanted = {(i, j): found for i, j in zip(a.tolist(), b.tolist(), strict=True) if (found := one_by_one(prints[i], prints[j]))}
    assert len(wanted) > 20
    for at_once in (1 << 18, 7):
        monkeypatch.setattr(media, "PLACES_AT_ONCE", at_once)
        monkeypatch.setattr(media, "INTEGERS_AT_ONCE", at_once)
        row, shift, errors = media.best_offsets(a, *laid(prints), b, *laid(prints))
        assert {(int(a[r]), int(b[r])): (e, s) for r, s, e in zip(row, shift.tolist(), errors.tolist(), strict=True)} == wanted


def test_op9_media_keys_are_made_once_a_recording(monkeypatch):
    prints, seen, made = some_prints(), [], media.composite_keys
    monkeypatch.setattr(media, "composite_keys", lambda p, sizes: seen.append(len(p)) or made(p, sizes))
    a, b = (c.ravel() for c in np.mgrid[: len(prints), : len(prints)])
    media.best_offsets(a, *laid(prints), b, *laid(prints))
    assert sum(seen) == 2 * sum(map(len, prints))


def test_op9_media_two_recordings_of_one_id_are_both_judged(spark):
    rng = np.random.default_rng(8)
    p, q = (rng.integers(0, 1 << 31, 80).astype(np.int32) for _ in range(2))
    near = lambda z: (z ^ (np.arange(80) == 40)).astype(np.int32).tolist()
    rows = [(5, b, x.tolist(), y) for x in (p, q) for b, y in ((7, near(p)), (9, near(q)))]
    pairs = spark.createDataFrame(rows, "a long, b long, x array<int>, y array<int>").coalesce(1)
    assert sorted((r.a, r.b, r.shift) for r in media.judged(pairs).collect()) == [(5, 7, 0), (5, 9, 0)]
