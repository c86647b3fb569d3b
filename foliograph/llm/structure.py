"""Plain counts of a text that the quality operators read: word, symbol, line and repetition statistics."""

from __future__ import annotations

import numpy as np

from foliograph.llm.textvec import SPACE, Piece, followed, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 full stop or comma, 4 other ASCII punctuation, 5 start of a code point beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[list(b".,")] = 3
_KIND[list(b"!\"'();:?@[]_`{}~/\\+=^-")] = 4
_KIND[192:] = 5

#: names of the columns of ``statistics``
STATISTICS = ("log_words", "mean_word", "symbols", "upper", "digits", "stops", "marks", "beyond", "distinct", "repeated_next", "dup_lines", "log_lines", "repeat_words")


def of_bytes(p: Piece, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged. A text's own closing line feed counts as its byte."""
    return np.add.reduceat(flags, p.doc_start[:-1], dtype=np.int64) if p.n else np.zeros(0, np.int64)


def duplicate_lines(texts: list[bytes]) -> np.ndarray:
    """Lines (between line feeds) with a word that equal an earlier line of the same text, byte for byte."""
    out = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")] if b"\n" in text else ()
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def repeated_words(texts: list[bytes], p: Piece, hashes: np.ndarray, window: int = 5) -> np.ndarray:
    """Words that lie in a run of ``window`` words which the same text has twice or more, first occurrences included.

    Hashes of the runs find the texts to look at; the count itself compares the words.
    """
    out = np.zeros(p.n, np.int64)
    run, at = followed(hashes, p.word_doc, window)
    if not len(run):
        return out
    doc = p.word_doc[at]
    order = np.sort((run >> np.uint64(20) << np.uint64(20)) ^ doc.astype(np.uint64))  # the text in the low bits
    twice = np.unique(order[1:][order[1:] == order[:-1]] & np.uint64((1 << 20) - 1)) if p.n < 1 << 20 else np.unique(doc)
    for d in twice.astype(int):
        words = texts[d].split()
        seen: dict[tuple, int] = {}
        ids = list(zip(*(words[k:] for k in range(window)), strict=False))
        for x in ids:
            seen[x] = seen.get(x, 0) + 1
        covered = np.zeros(len(words) + 1, np.int64)
        for i, x in enumerate(ids):
            if seen[x] > 1:
                covered[i] += 1
                covered[min(i + window, len(words))] -= 1
        out[d] = np.count_nonzero(np.cumsum(covered[:-1]) > 0)
    return out


def statistics(texts: list[bytes], p: Piece, hashes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its ``STATISTICS`` as one row of a matrix; an empty text's are 0."""
    n_words = np.bincount(p.word_doc, minlength=p.n)
    points = of_bytes(p, (p.buf & 0xC0) != 0x80) - of_bytes(p, SPACE[p.buf])
    kind = _KIND[p.buf]
    counts = {"n_words": n_words, "word_chars": points, "n_symbols": of_bytes(p, _SYMBOL[p.buf]), "n_dup_lines": duplicate_lines(texts), "n_repeat_words": repeated_words(texts, p, hashes)}
    per_char = np.maximum(points, 1)
    words = np.maximum(n_words, 1)
    key = np.sort((hashes >> np.uint64(20) << np.uint64(20)) ^ (p.word_doc.astype(np.uint64) & np.uint64((1 << 20) - 1)))
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[first] & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=p.n)
    same = (hashes[1:] == hashes[:-1]) & (p.word_doc[1:] == p.word_doc[:-1])
    next_same = np.bincount(p.word_doc[1:][same], minlength=p.n)
    lines = of_bytes(p, p.buf == 10)
    columns = [np.log1p(n_words), points / words / 10, counts["n_symbols"] / per_char, *(of_bytes(p, kind == k) / per_char for k in (1, 2, 3, 4, 5)), distinct / words, next_same / words, counts["n_dup_lines"] / lines, np.log(lines), counts["n_repeat_words"] / words]
    return counts, np.stack(columns, 1) * (n_words > 0)[:, None]
