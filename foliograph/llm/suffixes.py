"""Suffix-array dedup by a logarithmic index family: bytes that a 100-byte string repeated from earlier covers.

A position matters if the ``LENGTH`` bytes from it on occur earlier too. Positions are found in two rounds.

Anchors. Every window of ``LENGTH`` bytes has one anchor: the ``GRAM`` bytes within it whose hash is least (the leftmost of
equal ones), the same in every copy. Consecutive windows with one anchor in one place are a stretch. Equal stretches are
told by digest and anchor (128 bits): all but the first repeat it wholly. A stretch met before within the same batch of
texts is settled there and not dealt out. So copies are settled before the index, which would otherwise have to be sent
all bytes of the corpus.

Suffixes. An anchor that has different stretches stands where copies begin, end or differ. Only for those the bytes
themselves are fetched. They are dealt by anchor into shards; each shard takes them in the order of documents, in
batches. A batch gets a suffix array (its suffixes sorted by their first ``LENGTH`` bytes), is merge-scanned against
every level of the shard's index for matches of ``LENGTH``, and then becomes a level itself; levels of equal size merge,
so their number stays logarithmic and every suffix is moved log(n) times.

A byte is removed if a repeating window covers it; overlaps count, and windows are judged on the input.

Null texts are empty. Texts shorter than ``LENGTH`` lose nothing, and neither do rows without an id, which don't count
as earlier either. Rows equal in id and text are one document and get the same result; of different texts under one id
each loses what repeats in any of them. Of equal strings the one of the smallest id and place is kept. A text of any length
is one piece; an empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import binary_texts, checkpointed, lean, only_ids, pieces
from foliograph.llm.textvec import MULTIPLIERS, U, mix, rolling

LENGTH = 100
GRAM = 32
#: low bits of a hash that give way to its place
PLACE_BITS = 24
#: bytes of text that are settled among themselves before anything is dealt out
BATCH_BYTES = 4 << 20
#: suffixes that a batch of a shard's index holds
BATCH_SUFFIXES = 1 << 15
STRETCH = "anchor long, digest long, doc_id long, at int, n int, repeated boolean"


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor hash, digest of the stretch, text, first position and number of windows of every stretch of the texts."""
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none
    gram = rolling(buf, GRAM)
    # the least hash and, below it, its place: the leftmost of equal ones
    low = U((1 << PLACE_BITS) - 1)
    least = (gram & ~low) | (np.arange(len(gram)).astype(U) & low)
    width, span = LENGTH - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    whole = rolling(buf, LENGTH)
    end = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.arange(len(least))
    ok = at + LENGTH <= end[text]
    opens = ok.copy()
    opens[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(opens)
    if not len(first):
        return none
    n = np.add.reduceat(ok, first, dtype=np.int64)
    # a stretch is its first and last window and their distance
    digest = mix(mix(whole[first] * U(MULTIPLIERS[1]) + whole[first + n - 1]) + n.astype(U))
    place = first + (((least[first] & low).astype(np.int64) - first) & ((1 << PLACE_BITS) - 1))
    return mix(gram[place]), digest, text[first], first - (end - sizes)[text[first]], n


def dealt(docs: DataFrame) -> DataFrame:
    """Stretches of all texts; ``repeated`` where an earlier one of the same batch is equal."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = binary_texts(batch)
            # in the order of documents, so that the first of a batch is the first in it for good
            order = np.argsort(ids, kind="stable")
            start = 0
            for piece in pieces([texts[i] for i in order], BATCH_BYTES):
                own = ids[order[start : start + len(piece)]]
                start += len(piece)
                anchor, digest, text, at, n = stretches(piece)
                doc = own[text]
                place = np.lexsort((at, doc, digest))
                anchor, digest, doc, at, n = (x[place] for x in (anchor, digest, doc, at, n))
                again = np.zeros(len(place), bool)
                again[1:] = (digest[1:] == digest[:-1]) & (anchor[1:] == anchor[:-1])
                once = np.ones(len(place), bool)
                once[1:] = ~again[1:] | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # a row that is there twice is one document
                # what is settled needs no shard: it goes anywhere, without a digest
                anchor[again] = mix(doc[again].astype(U) * U(MULTIPLIERS[0]) + at[again].astype(U))
                digest[again] = 0
                fields = {"anchor": anchor.view(np.int64), "digest": digest.view(np.int64), "doc_id": doc, "at": at.astype(np.int32), "n": n.astype(np.int32), "repeated": again}
                yield pa.RecordBatch.from_pydict({k: pa.array(v[once]) for k, v in fields.items()})

    return docs.mapInArrow(lean(run), STRETCH)


class Settling:
    """Goes through stretches in the order of anchor, digest and document, a batch at a time; between batches it holds the last row
    and one row that may need comparing, however many stretches an anchor has."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # anchor, digest, repeated, document and place of the last row
        self.firsts = 0  # of the last row's anchor: how many digests so far
        self.pending: pa.RecordBatch | None = None  # its only first stretch so far

    def judge(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Repeated stretches, and the first of each digest of anchors with several."""
        anchor, digest, again, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "digest", "repeated", "doc_id", "at"))
        before = self.last or (None,) * 5
        differs = lambda x, held: np.concatenate([[held is None or x[0] != held], x[1:] != x[:-1]])
        new_anchor = differs(anchor, before[0])
        new = new_anchor | differs(digest, before[1]) | differs(again, before[2])
        twice = ~new & ~differs(doc, before[3]) & ~differs(at, before[4])
        group = np.cumsum(new_anchor) - (0 if not new_anchor[0] else 1)
        first = new & ~again
        firsts = np.bincount(group, weights=first).astype(np.int64)
        if not new_anchor[0]:
            firsts[0] += self.firsts
        several = firsts > 1
        held = self.pending
        if not new_anchor[0] and held is not None and several[0]:
            yield held
        if new_anchor.any() or several[0]:
            held = None  # it has been given, or its anchor has no other digest
        out = batch.select(["anchor", "doc_id", "at", "n"]).append_column("repeated", pa.array(again | ~new))
        own = np.flatnonzero(first & (group == group[-1]))
        if firsts[-1] == 1 and len(own):
            held = out.slice(int(own[0]), 1)
        self.last, self.firsts, self.pending = (anchor[-1], digest[-1], again[-1], doc[-1], at[-1]), int(firsts[-1]), held
        yield out.filter(pa.array((again | ~new | several[group]) & ~twice))


def settled(found: DataFrame) -> DataFrame:
    """``anchor, doc_id, at, n, repeated`` of stretches that repeat an equal one (repeated), and of the first of each of several
    stretches of one anchor (not repeated), whose bytes have to be compared."""

    # to each anchor's shard, in the order of anchor, digest and document
    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "repeated", "digest", "doc_id", "at")

    def run(batches):
        state = Settling()
        for batch in batches:
            if batch.num_rows:
                yield from state.judge(batch)

    return ordered.mapInArrow(lean(run), "anchor long, doc_id long, at int, n int, repeated boolean")


class Levels:
    """A shard's index: sorted arrays of suffixes, cut to ``LENGTH`` bytes, each level at least twice the next."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def seen(self, suffixes: np.ndarray) -> np.ndarray:
        """Merge scan: whether each of the sorted suffixes is in a level."""
        out = np.zeros(len(suffixes), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            out |= level[at] == suffixes
        return out

    def add(self, suffixes: np.ndarray) -> None:
        """A sorted batch becomes a level; levels no larger than it merge with it."""
        while self.levels and len(self.levels[-1]) <= len(suffixes):
            suffixes = np.concatenate([self.levels.pop(), suffixes])
            suffixes.sort(kind="stable")  # two sorted runs: a merge
        if len(suffixes):
            self.levels.append(suffixes)


def repeats(starts: np.ndarray, levels: Levels) -> np.ndarray:
    """Which of the windows, given in the order of documents, occur before in the batch or in the index, which takes the others up."""
    order = np.argsort(starts, kind="stable")  # the batch's suffix array
    array = starts[order]
    new = np.concatenate([[True], array[1:] != array[:-1]])
    again = ~new | levels.seen(array)
    levels.add(array[new & ~again])
    out = np.empty(len(starts), bool)
    out[order] = again
    return out


def compared(contexts: DataFrame) -> DataFrame:
    """``doc_id, at, n`` of the runs of windows that occur earlier; ``contexts (anchor, doc_id, at, bytes)``."""
    ordered = contexts.repartition("anchor").sortWithinPartitions("doc_id", "at")

    def run(batches):
        levels, last = Levels(), None
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            ids, ats = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at"))
            places = [last, *zip(ids.tolist(), ats.tolist(), strict=True)]
            once = [k for k in range(len(raw)) if places[k + 1] != places[k]]  # a row that is there twice is one document
            last = places[-1]
            raw, ids, ats = [raw[k] for k in once], ids[once], ats[once]
            start = 0
            while start < len(raw):
                stop, total = start, 0
                while stop < len(raw) and total < BATCH_SUFFIXES:
                    total += len(raw[stop]) - LENGTH + 1
                    stop += 1
                n = np.array([len(x) - LENGTH + 1 for x in raw[start:stop]])
                windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), LENGTH) for x in raw[start:stop]])
                again = repeats(np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel(), levels)
                owner = np.repeat(np.arange(start, stop), n)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                opens = again.copy()
                opens[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
                first = np.flatnonzero(opens)
                if len(first):
                    size = np.add.reduceat(again, first, dtype=np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[owner[first]]), "at": pa.array((ats[owner[first]] + inside[first]).astype(np.int32)), "n": pa.array(size.astype(np.int32))})
                start = stop

    return ordered.select("doc_id", "at", "bytes").mapInArrow(lean(run), "doc_id long, at int, n int")


def with_lists(docs: DataFrame, marks: DataFrame, rows: int) -> DataFrame:
    """Documents that have marks, with the marks' list; a document's marks are fewer than its bytes."""
    lists = marks.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in marks.columns if c != "doc_id"))).alias("marks"))
    named = marks.select("doc_id").distinct()
    return only_ids(docs, named, rows).join(lists, "doc_id")


def contexts_of(listed: DataFrame) -> DataFrame:
    """The bytes of every stretch asked for."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"anchor": [], "doc_id": [], "at": [], "bytes": []}
            for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), binary_texts(batch), batch.column("marks").to_pylist(), strict=True):
                for m in marks:
                    out["anchor"].append(m["anchor"])
                    out["doc_id"].append(doc_id)
                    out["at"].append(m["at"])
                    out["bytes"].append(text[m["at"] : m["at"] + m["n"] + LENGTH - 1])
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(out["anchor"], pa.int64()), "doc_id": pa.array(out["doc_id"], pa.int64()), "at": pa.array(out["at"], pa.int32()), "bytes": pa.array(out["bytes"], pa.binary())})

    return listed.mapInArrow(lean(run), "anchor long, doc_id long, at int, bytes binary")


def cut(text: bytes, marks: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs of removed bytes."""
    runs: list[tuple[int, int]] = []
    for at, end in sorted((m["at"], m["at"] + m["n"] + LENGTH - 1) for m in marks):
        if runs and at <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((at, end))
    left, here = [], 0
    for at, end in runs:
        left.append(text[here:at])
        here = end
    left.append(text[here:])
    return b"".join(left), runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def results(listed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), binary_texts(batch), batch.column("marks").to_pylist(), strict=True):
                left, runs = cut(text, marks)
                for k, v in zip(rows, (doc_id, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest()), strict=True):
                    rows[k].append(v)
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(rows.items(), kinds, strict=True)})

    return listed.mapInArrow(lean(run), RESULT)


def marks_of(docs: DataFrame) -> DataFrame:
    """``doc_id, at, n``: runs of n windows, from byte ``at`` on, that occur earlier."""
    found = checkpointed(settled(dealt(docs)))
    asked = found.where("not repeated").select("doc_id", "anchor", "at", "n")
    listed = with_lists(docs, asked, asked.select("doc_id").distinct().count())
    late = compared(contexts_of(listed))
    return checkpointed(found.where("repeated").select("doc_id", "at", "n").union(late))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``. Other columns are ignored."""
    docs = docs.select("doc_id", "text")
    marks = marks_of(docs.where("doc_id is not null and text is not null"))
    rows = marks.select("doc_id").distinct().count()
    touched = results(with_lists(docs, marks, rows))
    text = F.coalesce("text", F.lit(""))
    others = only_ids(docs, marks.select("doc_id").distinct(), rows, "left_anti")
    whole = others.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return touched.unionByName(whole)
