"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A word holds its part boundaries and the merge ranks of adjacent parts side by side; the smallest rank (the leftmost
among equals) is merged, its boundary deleted and the neighbouring ranks refreshed, until no adjacent pair can merge.
The words of a batch go through these steps together, one matrix row each. A word beyond ``SHORT`` bytes keeps the same
parts in a heap instead, so a text without any boundary costs n log n. Words met before are looked up.

Texts are split by the rules that the split pattern spells out, worked out over arrays of code points: which class
each one is of, where the class changes, which space goes with what follows. Words are told apart by 64-bit hashes.

A null text is an empty one: no ids. A text of any length is encoded whole. Of equal ranks the leftmost merges. Repeated
rows are encoded alike; a null id stays null. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from foliograph.llm.shared import each_text, lean, pieces
from foliograph.llm.textvec import MULTIPLIERS, U, mix, powers

#: letters that make a word of their own with an apostrophe before them (fixed values)
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
SHORT = 48
#: words that a worker remembers at most; then it starts anew
REMEMBERED = 1 << 19
NO_RANK = np.int32(0x7FFFFFFF)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else one beyond 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


LETTER, NUMBER, BLANK, OTHER, END = range(5)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; one past the last stands for the end of a text."""
    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    out[0x110000] = END
    return out


def word_starts(points: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; every text ends with END."""
    kind = classes()[points]
    start = np.ones(len(kind), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # before other characters a run of blanks gives up its last one: a space goes with them, another blank stands alone
    solid = np.flatnonzero(start[1:] & (kind[1:] < END) & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    start[solid - 1] = True
    start[solid] = points[solid - 1] != 32
    # an apostrophe by itself takes one of the suffixes; the letters after that are a word of their own
    lone = np.flatnonzero((points[:-3] == 39) & start[:-3] & (kind[1:-2] == LETTER))
    for suffix in SUFFIXES:
        hit = lone[np.logical_and.reduce([points[lone + 1 + k] == ord(c) for k, c in enumerate(suffix)])]
        start[hit + 1] = False
        start[hit + 1 + len(suffix)] |= (kind[hit + 1 + len(suffix)] == LETTER)
    return start


def hashes(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words that lie end to end in ``buf``."""
    inside = np.arange(len(buf)) - np.repeat(first, size)
    return mix(np.add.reduceat((buf.astype(U) + U(1)) * powers(int(size.max()))[inside], first) + size.astype(U) * U(MULTIPLIERS[2]))


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``flat[first : first + size]``, end to end."""
    at = np.repeat(first - (np.cumsum(size) - size), size)
    return flat[at + np.arange(len(at))]


class Coder:
    def __init__(self, content: str):
        spec = json.loads(content)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and spec.get("normalizer") is None
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("this coder takes byte-level BPE without normaliser, prefix space, affixes and dropout")
        vocab = model["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed([*enumerate(pairs)])}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        self.ranks, self.merged = (np.array([*(x[k] for x in self.rank.values()), NO_RANK], np.int32) for k in (0, 1))
        # an open hash table of the pairs: slots hold a pair's row; a full slot sends the pair to the next
        self.slot_bits = int(4 * len(keys)).bit_length()
        self.slot_key, self.slot_row = np.full(1 << self.slot_bits, -1, np.int64), np.full(1 << self.slot_bits, len(keys), np.int32)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            self.slot_key[at[todo[free]]] = keys[todo[free]]
            put = self.slot_key[at[todo]] == keys[todo]
            self.slot_row[at[todo[put]]] = todo[put]
            todo = todo[~put]
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        bytes_of |= {v: k.encode() for k, v in special.items()}
        parts = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.size_of = np.array([len(x) for x in parts])
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(0, U)  # hashes of the words met before, in order
        self.seen_start, self.seen_size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # their ids in seen_ids
        self.seen_ids = np.zeros(0, "<u4")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(MULTIPLIERS[0])) >> U(64 - self.slot_bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the merge table; its last row where it is in none."""
        key = left.astype(np.int64) << 32 | right
        at = self.slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_row[at], len(self.ranks) - 1)
        wrong = np.nonzero((held != key) & (held >= 0))
        while len(wrong[0]):
            at[wrong] = (at[wrong] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[wrong]]
            good = held == key[wrong]
            out[tuple(w[good] for w in wrong)] = self.slot_row[at[wrong]][good]
            on = ~good & (held >= 0)
            wrong = tuple(w[on] for w in wrong)
        return out

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, which go through the rank arrays together."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.first[raw]
        found = self.look_up(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((n, 0), np.int64)
        ranks = np.full((n, width), NO_RANK, np.int32)  # the rank of part j with part j + 1
        ranks[:, :-1] = np.where(np.arange(1, width)[None, :] < size[:, None], self.ranks[found], NO_RANK)
        live = np.arange(n)
        out_parts, out_size = parts.copy(), size.copy()
        columns = np.arange(width)[None, :]
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            on = ranks[row, at] != NO_RANK
            if not on.all():
                out_parts[live[~on]], out_size[live[~on]] = parts[~on], size[~on]
                live, parts, ranks, size, at = live[on], parts[on], ranks[on], size[on], at[on]
                row = np.arange(len(live))
                if not len(live):
                    break
            new = self.merged[self.look_up(parts[row, at], parts[row, at + 1])]
            # delete the boundary: what lies behind it moves one place to the left
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            source = np.minimum(columns + (columns >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NO_RANK
            parts[row, at] = new
            size = size - 1
            right = at + 1 < size
            ranks[row, at] = np.where(right, self.ranks[self.look_up(new, parts[row, np.minimum(at + 1, width - 1)])], NO_RANK)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks[self.look_up(parts[left, at[left] - 1], new[left])]
        return [p[:k].astype("<u4").tobytes() for p, k in zip(out_parts, out_size, strict=True)]

    def encode_long(self, word: bytes) -> bytes:
        """The same merges for one long word: parts in a linked list, ranks in a heap."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue  # one of the parts has been merged meanwhile
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn_words(self, known: np.ndarray, words: list[bytes]) -> None:
        """Encodes words not met before, which have the sorted hashes ``known``."""
        if len(self.seen) + len(words) > REMEMBERED:
            self.forget()
        ids: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > SHORT:
                ids[k] = self.encode_long(w)
            else:
                by_size.setdefault((len(w) + 1) // 2, []).append(k)
        for group in by_size.values():
            for lo in range(0, len(group), 1 << 13):
                part = group[lo : lo + (1 << 13)]
                for k, x in zip(part, self.encode_short([words[k] for k in part]), strict=True):
                    ids[k] = x
        size = np.array([len(x) // 4 for x in ids])
        start = np.cumsum(size) - size + len(self.seen_ids)
        self.seen_ids = np.concatenate([self.seen_ids, np.frombuffer(b"".join(ids), "<u4")])
        place = np.searchsorted(self.seen, known)
        self.seen, self.seen_start, self.seen_size = (np.insert(a, place, b) for a, b in ((self.seen, known), (self.seen_start, start), (self.seen_size, size)))

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens in them."""
        points = np.frombuffer("\0".join(texts).encode("utf-32-le") + b"\0\0\0\0", np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = 0x110000
        opens = np.flatnonzero(word_starts(points))
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        width[ends] = 0
        at = np.cumsum(width) - width
        first = at[opens]
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        size = np.diff(np.append(first, len(buf)))
        owner = np.searchsorted(ends, opens, "left")
        real = size > 0  # not an end
        first, size, owner = first[real], size[real], owner[real]
        if not len(first):
            return [b""] * len(texts)
        h = hashes(buf, first, size)
        row = np.searchsorted(self.seen, h)
        missing = np.flatnonzero(np.append(self.seen, U(0))[row] != h) if len(self.seen) else np.arange(len(h))
        if len(missing):
            if len(self.seen) + len(missing) > REMEMBERED:
                self.forget()
                missing = np.arange(len(h))
            known, one = np.unique(h[missing], return_index=True)
            one = missing[one]
            whole = buf.tobytes()
            self.learn_words(known, [whole[a : a + n] for a, n in zip(first[one].tolist(), size[one].tolist(), strict=True)])
            row = np.searchsorted(self.seen, h)
        ids = gather(self.seen_ids, self.seen_start[row], self.seen_size[row]).astype("<u4").tobytes()
        cut = np.cumsum(np.bincount(owner, weights=self.seen_size[row], minlength=len(texts))).astype(int) * 4
        return [ids[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        if not self.split_special or not any(s in t for t in texts for s in self.special):
            return self.encode_plain(texts)
        split = [self.split_special.split(t) for t in texts]
        plain = iter(self.encode_plain([x for parts in split for x in parts[::2]]))
        return [b"".join(self.special[x] if k % 2 else next(plain) for k, x in enumerate(parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        row = np.frombuffer(ids, "<u4")
        return gather(self.all_bytes, self.start_of[row], self.size_of[row]).tobytes().decode("utf-8", "replace")

    def decoded(self, ids: list[bytes]) -> list[bytes]:
        """The UTF-8 bytes that the ids of some texts stand for."""
        row = np.frombuffer(b"".join(ids), "<u4")
        size = self.size_of[row]
        flat = gather(self.all_bytes, self.start_of[row], size).tobytes()
        end = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(x) // 4 for x in ids])].tolist()
        return [flat[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]


@lru_cache(2)
def coder(content: str) -> Coder:
    return Coder(content)


def tokenizer_file(path: str) -> str:
    """The tokenizer's definition, read once on the driver; the executors get it by broadcast (2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the ids, their number and digest, and the digest of what they decode to. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        for batch in batches:
            of = coder(shared.value)
            n, ids_digest, text_digest = [], [], []
            for piece in pieces(each_text(batch)):
                encoded = of.encode([t.decode("utf-8", "replace") for t in piece])
                for ids, raw in zip(encoded, of.decoded(encoded), strict=True):
                    n.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(raw if raw.isascii() else raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()), "decoded_sha256": pa.array(text_digest, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` with the ids as an array, for whoever trains on them."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for piece in pieces(each_text(batch)) for x in coder(shared.value).encode([t.decode("utf-8", "replace") for t in piece])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def texts_of(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of what ``token_ids`` returned; null ids give an empty text."""
    shared = spark.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        for batch in batches:
            texts = [coder(shared.value).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
