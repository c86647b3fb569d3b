"""The composite keys of the recordings' index against all pairs and all offsets."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import media


def every_match(prints: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> set[tuple[int, int]]:
    """Pairs whose least share of differing bits over all offsets is within the limit, by trying them all."""
    n, found = prints.shape[1], set()
    for q in np.flatnonzero(asked):
        least = np.full(len(prints), 9.0)
        for shift in range(-(n - media.LEAST_OVERLAP), n - media.LEAST_OVERLAP + 1):
            x, y = prints[q, max(shift, 0) : n + min(shift, 0)], prints[:, max(-shift, 0) : n - max(shift, 0)]
            least = np.minimum(least, np.bitwise_count(x ^ y).sum(1) / (32 * len(x)))
        found |= {(int(ids[q]), int(ids[k])) for k in np.flatnonzero(least <= media.MOST_ERRORS) if k != q}
    return found


def test_index_finds_nine_of_ten(spark):
    rng = np.random.default_rng(5)
    bases = rng.normal(size=(60, 64))
    vectors = np.concatenate([bases, *(bases + rng.normal(scale=s, size=bases.shape) for s in (0.03, 0.05, 0.08))])
    sounds = [media.melody(v) for v in vectors]
    prints = np.stack([media.fingerprint(media.chroma(*media.decode(s))) for s in sounds])
    ids = np.arange(len(sounds))
    wanted = every_match(prints, ids, np.ones(len(ids), bool))
    rows = media.aligned(spark.createDataFrame([(int(i), s) for i, s in zip(ids, sounds, strict=True)], "id long, media binary"), "true").collect()
    class_of = {r.a: r.b for r in rows if r.kind == "member"}
    wanted = {(a, b) for a, b in wanted if class_of[a] != class_of[b] and class_of[a] == a and class_of[b] == b}
    got = {(r.a, r.b) for r in rows if r.kind == "match"}
    assert len(wanted) > 100
    assert len(wanted & got) >= 0.9 * len(wanted)
    assert got <= wanted


def test_odd_recordings(spark):
    tone = media.melody(np.sin(np.arange(64.0)))
    rows = [(1, None), (2, b""), (3, b"RIFF no sound"), (4, tone), (4, tone), (5, tone), (None, tone), (6, media.melody(np.zeros(1)))]
    odd = spark.createDataFrame(rows, "id long, media binary").withColumn("class", F.lit(1)).withColumn("key", F.lit("x"))
    found = media.aligned(odd, "id % 2 = 0").collect()
    assert sorted((r.a, r.b) for r in found if r.kind == "member") == [(4, 4), (4, 4), (5, 4)]
    assert not [r for r in found if r.kind == "match"]
    assert media.aligned(odd.where("false"), "true").collect() == []


def rendered(values: np.ndarray, rate: int, width: int, channels: int) -> bytes:
    """The notes of ``melody`` at another rate, width and number of channels."""
    step = np.clip(np.floor((values - values.mean()) / values.std() * 4 + 12.5), 0, 23)
    pitch = np.repeat(440 * 2 ** (step / 12), int(rate * media.NOTE / media.RATE))
    x = np.repeat(0.7 * np.sin(2 * np.pi * np.cumsum(pitch) / rate)[:, None], channels, 1).ravel()
    if width == 1:
        raw = (x * 127 + 128).astype(np.uint8).tobytes()
    else:
        whole = (x * ((1 << (8 * width - 1)) - 1)).astype("<i4")
        raw = whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


@pytest.mark.parametrize("rate,width,channels", [(8000, 2, 1), (16000, 3, 2), (44100, 2, 2), (11025, 4, 1), (48000, 3, 1)])
def test_a_melody_matches_itself_at_any_rate(rate, width, channels):
    for seed in range(3):
        values = np.random.default_rng(seed).normal(size=64)
        own, other = (media.fingerprint(media.chroma(*media.decode(s))) for s in (media.melody(values), rendered(values, rate, width, channels)))
        n = min(len(own), len(other))
        assert abs(len(own) - len(other)) <= 1
        assert np.bitwise_count(own[:n] ^ other[:n]).sum() / (32 * n) < 0.05


def test_recall_over_mixed_rates(spark):
    rng = np.random.default_rng(9)
    bases = rng.normal(size=(40, 64))
    rates = [(4000, 1, 1), (8000, 2, 1), (16000, 3, 2), (44100, 2, 1)]
    sounds = [(100 * k + j, rendered(b + rng.normal(scale=0.02 * (j > 0), size=64), *rates[(k + j) % 4])) for k, b in enumerate(bases) for j in range(3)]
    rows = media.aligned(spark.createDataFrame(sounds, "id long, media binary"), "true").collect()
    class_of = {r.a: r.b for r in rows if r.kind == "member"}
    got = {(r.a, r.b) for r in rows if r.kind == "match"}
    prints = {i: media.fingerprint(media.chroma(*media.decode(s))) for i, s in sounds}
    n = min(map(len, prints.values()))
    wanted = every_match(np.stack([prints[i][:n] for i, _ in sounds]), np.array([i for i, _ in sounds]), np.ones(len(sounds), bool))
    wanted = {(a, b) for a, b in wanted if class_of[a] != class_of[b] and class_of[a] == a and class_of[b] == b}
    assert len(wanted) > 100 and len(wanted & got) >= 0.9 * len(wanted)


def test_blocks_make_one_recording(monkeypatch):
    sound = rendered(np.random.default_rng(4).normal(size=64), 44100, 2, 1)
    whole, _ = media.decode(sound)
    monkeypatch.setattr(media, "SAMPLES_AT_ONCE", 1000)
    assert np.allclose(media.decode(sound)[0], whole, atol=1e-5)
    tone = np.sin(2 * np.pi * 440 * np.arange(len(whole)) / media.RATE)
    assert len(whole) == len(tone)


def test_undecodable_rates_and_widths(spark):
    header = lambda rate, width: b"RIFF" + struct.pack("<I", 36 + 800) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * width, width, 8 * width) + b"data" + struct.pack("<I", 800) + bytes(800)
    assert all(len(media.decode(header(*x))[0]) == 0 for x in ((0, 2), (1 << 30, 2), (4000, 5)))
    assert len(media.decode(header(4000, 2))[0]) == 400
    rows = [(1, header(0, 2)), (2, header(4000, 2)[:50]), (3, header(8000, 3))]
    assert media.aligned(spark.createDataFrame(rows, "id long, media binary"), "true").collect() == []
