"""Vectorised views of texts: words, word hashes and byte n-gram hashes of many texts at once.

Texts are laid end to end, each followed by a line feed, so that no word or n-gram of one reaches into the next.
White space is the six ASCII characters space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: odd multipliers of the rolling and finishing steps
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every bit of the result depends on every bit given."""
    h = (h ^ (h >> U(32))) * U(MULTIPLIERS[3])
    h = (h ^ (h >> U(29))) * U(MULTIPLIERS[1])
    return h ^ (h >> U(32))


@dataclass
class Piece:
    """Some texts, laid end to end. ``doc_start`` has one entry more than there are texts."""

    buf: np.ndarray
    doc_start: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    word_doc: np.ndarray

    @property
    def n(self) -> int:
        return len(self.doc_start) - 1


def lay(texts: list[bytes], lower: bool = False) -> Piece:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    doc_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=doc_start[1:])
    solid = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    return Piece(buf, doc_start, start, end, np.searchsorted(doc_start, start, "right") - 1)


def powers(n: int) -> np.ndarray:
    """1, m, m^2 ... for an odd m, modulo 2^64."""
    out = np.full(n, MULTIPLIERS[0], U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def word_hashes(p: Piece) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the word, finished with its length."""
    if not len(p.word_start):
        return np.zeros(0, U)
    length = p.word_end - p.word_start
    at = np.arange(length.sum(), dtype=np.int64)
    first = np.cumsum(length) - length
    inside = at - np.repeat(first, length)
    value = (p.buf[inside + np.repeat(p.word_start, length)].astype(U) + U(1)) * powers(int(length.max()))[inside]
    return mix(np.add.reduceat(value, first) + length.astype(U) * U(MULTIPLIERS[2]))


def followed(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a text, and the index of each run's first word."""
    if len(h) < n:
        return h[:0], np.zeros(0, np.int64)
    run = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        run = mix(run * U(MULTIPLIERS[4]) + h[k : len(h) - n + 1 + k])
    whole = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    return run[whole], whole


def characters(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, its UTF-8 bytes one above the other, and where each text's begin among them."""
    tail = np.append((p.buf & 0xC0) == 0x80, np.zeros(3, bool))
    at = np.flatnonzero(~tail[: len(p.buf)])
    out, more = p.buf[at].astype(U), np.ones(len(at), bool)
    wide = np.append(p.buf, np.zeros(3, np.uint8))
    for k in (1, 2, 3):
        more &= tail[at + k]
        if not more.any():
            break
        out[more] |= wide[at[more] + k].astype(U) << U(8 * k)
    return out, np.searchsorted(at, p.doc_start)


def rolling(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` bytes (or numbers of characters), built by doubling."""
    if len(buf) < n:
        return np.zeros(0, U)
    h = (buf.astype(U) + U(1)) * U(MULTIPLIERS[7])
    h ^= h >> U(29)
    size = k = 0
    size = 1
    while size < n:
        step = min(size, n - size)
        h = h[:-step] * U(MULTIPLIERS[k]) + h[step:]
        h ^= h >> U(31)
        size += step
        k += 1
    return h * U(MULTIPLIERS[6])


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)
