"""Media columns: chroma audio fingerprints, and the alignment of recordings by them.

A recording is a WAV file in a binary column: PCM of 8 to 32 bits, any number of channels, any rate; it is read in blocks and brought to
``RATE`` by a windowed sinc, so that a recording matches itself at another rate. Its spectrum is folded into twelve pitch classes a frame; an integral
image over frames and classes gives the sums under ``FILTERS`` rectangles in constant time each; every filter compares
two areas and yields two bits, and the filters of a frame are packed into one integer.

Recordings with the same fingerprint form a class, named by its smallest id. A single integer of a smooth recording is
common, so the index goes by composite keys: the steady bits of three integers at fixed distances (``DISTANCES``).
Classes that share keys with a query's class are aligned, each pair once, however many keys it shares: the index holds a key's classes in
blocks of ``BLOCK`` ids. The differences of the shared keys' places make a histogram of offsets.
Each offset in it, and the two next to it, is judged by the share of differing bits over the overlap; the least wins, of
equal ones the fullest and then the smallest. No count is capped, and copies never meet.

Null, empty and undecodable media (rates of 0 or beyond ``MOST_RATE`` too), and recordings shorter than a filter, have the empty fingerprint: they are in no
class and match nothing. A row without an id is left out. Repeated rows of one id are members alike; of several
recordings under one id each is in a class. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed, lean
from foliograph.llm.textvec import MULTIPLIERS, U, mix

FRAME = 512
HOP = 128
CLASSES = 12
#: pitch classes are told from this frequency up, over this many octaves
LOWEST = 220.0
OCTAVES = 4
SPAN = 16
#: (kind, first class, classes, frames): filters over SPAN frames, by rule: every kind at four heights and widths
FILTERS = tuple((kind, (3 * k + 2 * kind) % CLASSES, 2 + k, (4, 8, 12, 16)[(k + kind) % 4]) for kind in range(4) for k in range(4))
#: a filter's value between -EDGE, 0 and EDGE falls into one of four steps
EDGE = 0.12
#: share of differing bits up to which aligned recordings match, and integers they must overlap in
MOST_ERRORS = 0.2
LEAST_OVERLAP = 32
#: places of the integers of a composite key, none reaching over LEAST_OVERLAP integers
DISTANCES = ((0, 15, 30), (0, 12, 24))
#: the bits of a composite key: which of the two areas is greater, for the filters of four classes and more
STEADY = sum(2 << 2 * k for k, (_, _, classes, _) in enumerate(FILTERS) if classes >= 4)
#: ids of a block of the index, and places that are compared at a time
BLOCK, PLACES_AT_ONCE = 4096, 1 << 18
#: integers of fingerprints that are indexed or compared at a time
INTEGERS_AT_ONCE = 1 << 19
#: recordings whose fingerprints are made at a time, and samples and frames of one that are
AT_ONCE, SAMPLES_AT_ONCE, FRAMES_AT_ONCE = 256, 1 << 18, 4096
#: the rate that all recordings are brought to, the highest that is read, and the waves of the kernel on either side
RATE, MOST_RATE, LOBES = 4000, 1 << 20, 8


def sound(data: bytes | None) -> tuple[int, Iterator[np.ndarray]]:
    """The rate of a WAV file, and its mono samples from -1 to 1, some at a time; rate 0 for what isn't PCM WAV of a rate up to ``MOST_RATE``."""
    try:
        w = wave.open(io.BytesIO(data or b""))
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return 0, iter(())
    if not 0 < rate <= MOST_RATE or width not in (1, 2, 3, 4):
        return 0, iter(())

    def blocks() -> Iterator[np.ndarray]:
        while raw := w.readframes(SAMPLES_AT_ONCE):
            n = len(raw) // (width * channels) * channels
            if width == 1:
                x = np.frombuffer(raw, np.uint8, n).astype(np.float32) / 128 - 1
            elif width == 3:
                parts = np.frombuffer(raw, np.uint8, 3 * n).reshape(-1, 3).astype(np.int32)
                x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) / float(1 << 31)).astype(np.float32)
            else:
                x = np.frombuffer(raw, f"<i{width}", n).astype(np.float32) / float(1 << (8 * width - 1))
            yield x.reshape(-1, channels).mean(1)

    return rate, blocks()


@lru_cache(8)
def kernel(rate: int) -> tuple[int, int, int, np.ndarray]:
    """``up, down, half`` and the weights of the samples around a place, a row for each phase: a windowed sinc below both rates' half."""
    up, down = RATE // gcd(rate, RATE), rate // gcd(rate, RATE)
    cutoff = 0.9 * min(1.0, RATE / rate)
    half = ceil(LOBES / cutoff)
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cutoff * np.sinc(cutoff * t) * np.cos(np.pi / 2 * np.clip(t / half, -1, 1)) ** 2
    return up, down, half, (h / h.sum(1, keepdims=True)).astype(np.float32)


def resampled(rate: int, blocks: Iterator[np.ndarray]) -> np.ndarray:
    """Samples at ``RATE``, from blocks at another rate; memory holds one block and the result."""
    if rate == RATE:
        return np.concatenate([np.zeros(0, np.float32), *blocks])
    up, down, half, weights = kernel(rate)
    held, first, k, total, out = np.zeros(half, np.float32), -half, 0, 0, []
    for block in chain(blocks, [None]):
        total += 0 if block is None else len(block)
        held = np.concatenate([held, np.zeros(half + down, np.float32) if block is None else block])
        # places whose samples are all there, and at the end those within the recording
        end = min(-(-total * up // down), ((first + len(held) - half - 1) * up) // down + 1)
        while k < end:
            at = np.arange(k, min(k + 4096, end), dtype=np.int64) * down
            rows = np.lib.stride_tricks.sliding_window_view(held, 2 * half)[at // up - half + 1 - first]
            out.append((rows * weights[at % up]).sum(1))
            k += len(at)
        gone = k * down // up - half + 1 - first
        if gone > 0:
            held, first = held[gone:], first + gone
    return np.concatenate([np.zeros(0, np.float32), *out])


def decode(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 at ``RATE``, and that rate; nothing and 0 for what can't be decoded."""
    rate, blocks = sound(data)
    return (resampled(rate, blocks), RATE) if rate else (np.zeros(0, np.float32), 0)


def folding(rate: int) -> np.ndarray:
    """Which pitch class each spectral line belongs to, as a matrix."""
    lines = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(lines), CLASSES), np.float32)
    ok = (lines >= LOWEST) & (lines < LOWEST * 2**OCTAVES)
    out[ok, np.floor(CLASSES * np.log2(lines[ok] / LOWEST) + 0.5).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class strengths of every frame, each frame scaled to length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), np.float32)
    frames, window, classes = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32), folding(rate)
    parts = [(np.abs(np.fft.rfft(frames[k : k + FRAMES_AT_ONCE] * window, axis=1)) ** 2).astype(np.float32) @ classes for k in range(0, len(frames), FRAMES_AT_ONCE)]
    out = np.concatenate(parts)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each place of the filters along the frames of a chroma image."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 2 * CLASSES + 1))
    integral[1:, 1:] = np.concatenate([image, image], 1).cumsum(0).cumsum(1)  # classes wrap around

    def area(at: int, frames: int, low: int, classes: int) -> np.ndarray:
        a, b = integral[at : at + n], integral[at + frames : at + frames + n]
        return b[:, low + classes] - b[:, low] - a[:, low + classes] + a[:, low]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, classes, frames) in enumerate(FILTERS):
        if kind == 0:  # against the classes across
            x, y = area(0, frames, low, classes), area(0, frames, (low + 6) % CLASSES, classes)
        elif kind == 1:  # the first half of the frames against the second
            x, y = area(0, frames // 2, low, classes), area(frames // 2, frames // 2, low, classes)
        elif kind == 2:  # against the classes next to them
            x, y = area(0, frames, low, classes), area(0, frames, (low + classes) % CLASSES, classes)
        else:  # crosswise
            half = frames // 2
            x = area(0, half, low, classes) + area(half, half, (low + classes) % CLASSES, classes)
            y = area(half, half, low, classes) + area(0, half, (low + classes) % CLASSES, classes)
        value = np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(y, 0))
        step = (value > -EDGE).astype(np.uint32) + (value > 0) + (value > EDGE)
        out |= (step ^ (step >> 1)).astype(np.uint32) << np.uint32(2 * k)  # Gray code: neighbouring steps differ in one bit
    return out


def fingerprints(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """``id, prints`` of every row: packed integers, one a place."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                prints = [fingerprint(chroma(*decode(x.as_py()))).view(np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "prints": pa.array(prints, pa.list_(pa.int32()))})

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(lean(run), "id long, prints array<int>")


def portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows, as ``lo, hi``, that hold up to ``INTEGERS_AT_ONCE`` integers together; a larger row is one of its own."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + INTEGERS_AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def lengths(column: pa.ListArray) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def composite_keys(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, key, place`` of the composite keys of fingerprints that lie end to end, ``sizes`` integers each; of a run of equal keys the first."""
    steady = (prints.view(np.uint32) & np.uint32(STEADY)).astype(U)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(prints)) - (np.cumsum(sizes) - sizes)[owner]
    left = sizes[owner] - place
    found = []
    for family, distances in enumerate(DISTANCES):
        n = max(len(prints) - max(distances), 0)
        key = np.full(n, family + 1, U)
        for d in distances:
            key = mix(key * U(MULTIPLIERS[5]) + steady[d : d + n])
        begins = place[:n] == 0
        begins[1:] |= key[1:] != key[:-1]
        kept = np.flatnonzero(begins & (left[:n] > max(distances)))
        found.append((owner[kept], key[kept], place[kept]))
    owners, keys, places = (np.concatenate(c) for c in zip(*found, strict=True))
    return owners, keys, places


def indexed(whole: DataFrame) -> DataFrame:
    """``class, asked, key``: the composite keys of every class, each once."""

    def run(batches):
        for batch in batches:
            for lo, hi in portions(lengths(batch.column("prints"))):
                part = batch.slice(lo, hi - lo)
                prints = part.column("prints")
                owner, key, _ = composite_keys(prints.flatten().to_numpy(), lengths(prints))
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                of = pa.array(owner[first])
                yield pa.RecordBatch.from_pydict({"class": part.column("class").take(of), "asked": part.column("asked").take(of), "key": pa.array(key[first].view(np.int64))})

    return whole.select("class", "asked", "prints").mapInArrow(lean(run), "class long, asked boolean, key long")


def candidates(keys: DataFrame) -> DataFrame:
    """``a, b``: each class of a query and each other class that shares a key with it, once. Of a key a block of classes is one row, so that classes
    that share many keys meet in as many rows as there are keys and blocks, and become pairs afterwards."""
    blocks = keys.groupBy("key", F.floor(F.col("class") / BLOCK).alias("block")).agg(F.collect_set("class").alias("classes"))
    met = keys.where("asked").select(F.col("class").alias("a"), "key").join(blocks, "key")
    # a block has BLOCK classes at most, and a recording as many keys as places
    others = met.groupBy("a", "block").agg(F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
    return others.select("a", F.explode(F.array_remove("classes", F.col("a"))).alias("b"))


def summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct value, and the sum of its counts."""
    value, of = np.unique(np.concatenate(values), return_inverse=True)
    return value, np.bincount(of, np.concatenate(counts), len(value)).astype(np.int64)


def differences(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By how much the places of equal keys differ, and how often. Memory holds ``PLACES_AT_ONCE`` of them, and the distinct ones."""
    order = np.argsort(y[0], kind="stable")
    keys, places = y[0][order], y[1][order]
    first = np.searchsorted(keys, x[0])
    n = np.searchsorted(keys, x[0], "right") - first
    met = np.flatnonzero(n)
    own, first, n = x[1][met], first[met], n[met]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    values, counts, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], PLACES_AT_ONCE
    for lo in range(0, total, PLACES_AT_ONCE):
        at = np.arange(lo, min(lo + PLACES_AT_ONCE, total))
        of = np.searchsorted(ends, at, "right")
        value, count = np.unique(own[of] - places[first[of] + at - (ends - n)[of]], return_counts=True)
        values.append(value)
        counts.append(count)
        if sum(map(len, values)) > 2 * most:
            value, count = summed(values, counts)
            values, counts, most = [value], [count], max(len(value), PLACES_AT_ONCE)
    return summed(values, counts)


def offsets_of(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> list[dict]:
    """The histogram of offsets of two recordings' keys and places: ``shift, n`` for every difference of places of one key."""
    return [{"shift": s, "n": n} for s, n in zip(*(c.tolist() for c in differences(x, y)), strict=True)]


def recordings_in(ids: pa.Array, prints: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the distinct recordings each row has; and these, end to end, with their sizes."""
    flat, sizes = prints.flatten().to_numpy(), lengths(prints)
    known: dict[tuple[int, bytes], int] = {}
    ends = np.cumsum(sizes).tolist()
    which = [known.setdefault((i, flat[end - n : end].tobytes()), len(known)) for i, end, n in zip(ids.to_pylist(), ends, sizes.tolist(), strict=True)]
    parts = [np.frombuffer(p, np.uint32) for _, p in known]
    return np.array(which), np.concatenate(parts), np.array([len(p) for p in parts])


def wrong_bits(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bits differ between ``sizes`` integers of ``x`` from ``at_x`` on and as many of ``y`` from ``at_y`` on."""
    out = np.zeros(len(sizes), np.int64)
    for lo, hi in portions(sizes):
        n = sizes[lo:hi]
        first = np.cumsum(n) - n
        along = np.arange(int(n.sum()))
        bits = np.bitwise_count(x[np.repeat(at_x[lo:hi] - first, n) + along] ^ y[np.repeat(at_y[lo:hi] - first, n) + along])
        out[lo:hi] = np.add.reduceat(bits, first, dtype=np.int64)
    return out


def best_offsets(a: np.ndarray, x: np.ndarray, x_sizes: np.ndarray, b: np.ndarray, y: np.ndarray, y_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (``a`` numbers a recording in ``x``, ``b`` one in ``y``) that match: their places, the offsets where they agree best, of those
    in their histogram and next to it that leave an overlap, and the shares of differing bits there.

    Recordings lie end to end, so far apart that a difference of places tells the pair and its offset: keys are looked up once a recording, not once a pair.
    """
    base = int(y_sizes.max()) + 1
    span = int(x_sizes.max()) + base + 2
    i, x_key, x_place = composite_keys(x, x_sizes)
    j, y_key, y_place = composite_keys(y, y_sizes)
    code, n = differences((x_key, i * len(y_sizes) * span + x_place + base), (y_key, y_place - j * span))
    pairs, row = np.unique(a * len(y_sizes) + b, return_index=True)
    at = np.minimum(np.searchsorted(pairs, code // span), len(pairs) - 1)
    here = pairs[at] == code // span
    code, n = summed([code[here] - 1, code[here], code[here] + 1], [0 * n[here], n[here], 0 * n[here]])
    row, shift = row[np.searchsorted(pairs, code // span)], code % span - base
    over_x, over_y = np.maximum(shift, 0), np.maximum(-shift, 0)
    sizes = np.minimum(x_sizes[a[row]] - over_x, y_sizes[b[row]] - over_y)
    enough = sizes >= LEAST_OVERLAP
    row, shift, n, over_x, over_y, sizes = (c[enough] for c in (row, shift, n, over_x, over_y, sizes))
    first_x, first_y = np.cumsum(x_sizes) - x_sizes, np.cumsum(y_sizes) - y_sizes
    errors = wrong_bits(x, y, first_x[a[row]] + over_x, first_y[b[row]] + over_y, sizes) / (sizes * 2 * len(FILTERS))
    good = errors <= MOST_ERRORS
    row, shift, n, errors = (c[good] for c in (row, shift, n, errors))
    order = np.lexsort((shift, np.abs(shift), -n, errors, row))
    row, best = np.unique(row[order], return_index=True)
    return row, shift[order][best], errors[order][best]


def judged(pairs: DataFrame) -> DataFrame:
    """``a, b, shift, errors`` of the pairs (``a, b, x, y``) that match at their best offset. They come by ``b``, so that a recording's pairs are together."""

    def run(batches):
        for batch in batches:
            for lo, hi in portions(lengths(batch.column("x")) + lengths(batch.column("y"))):
                part = batch.slice(lo, hi - lo)
                row, shift, errors = best_offsets(*recordings_in(part.column("a"), part.column("x")), *recordings_in(part.column("b"), part.column("y")))
                found = part.select(["a", "b"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(shift, pa.int32()), pa.array(errors)], names=["a", "b", "shift", "errors"])

    return pairs.select("a", "b", "x", "y").sortWithinPartitions("b").mapInArrow(lean(run), "a long, b long, shift int, errors double")


def aligned(media: DataFrame, queries: str, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """Classes of recordings, and how the classes of the queries match all classes.

    ``queries`` is a condition on ``id``. The result has rows of two kinds: ``member`` (``a`` an id, ``b`` its class) and
    ``match`` (``a`` a query's class, ``b`` a matching class that isn't it, ``shift`` the offset of b against a, ``errors``
    the share of differing bits over the overlap).
    """
    prints = checkpointed(fingerprints(media, id_column, media_column).where((F.size("prints") > 0) & F.col("id").isNotNull()).withColumn("key", F.sha2(F.array_join("prints", ","), 256)))
    classes = checkpointed(prints.groupBy("key").agg(F.min("id").alias("class"), F.max(F.expr(queries)).alias("asked")))
    whole = checkpointed(prints.join(classes.withColumnRenamed("class", "id"), ["key", "id"]).dropDuplicates(["key"]).select(F.col("id").alias("class"), F.coalesce("asked", F.lit(False)).alias("asked"), "prints"))
    keys = checkpointed(indexed(whole))
    pairs = candidates(keys).join(whole.where("asked").select(F.col("class").alias("a"), F.col("prints").alias("x")), "a").join(whole.select(F.col("class").alias("b"), F.col("prints").alias("y")), "b")
    match = judged(pairs).select(F.lit("match").alias("kind"), "a", "b", "shift", F.round("errors", 6).alias("errors"))
    member = prints.join(classes, "key").select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("class").alias("b"), F.lit(0).alias("shift"), F.lit(0.0).alias("errors"))
    return member.unionByName(match.distinct())


#: what the adapter below renders: samples a second, and samples a note
NOTE = 256


def melody(values: np.ndarray) -> bytes:
    """A vector as a recording: each value, against the vector's spread, is a note of two octaves."""
    spread = values.std()
    step = np.clip(np.floor((values - values.mean()) / (spread if spread > 0 else 1) * 4 + 12.5), 0, 23)
    pitch = np.repeat(440 * 2 ** (step / 12), NOTE)
    sound = np.sin(2 * np.pi * np.cumsum(pitch) / RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes((sound * 100 + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def recordings(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, media``: the tables hold no sound, so vectors are rendered as melodies. A null or empty vector has null media."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                media = [melody(np.nan_to_num(np.array([v or 0 for v in x], float))) if x else None for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "media": pa.array(media, pa.binary())})

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).mapInArrow(lean(run), "id long, media binary")
