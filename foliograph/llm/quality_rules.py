"""Quality rules: counted rules, and a hashed n-gram logistic regression with calibrated probabilities.

The regression reads hashed word 1- and 2-grams and character 3- and 4-grams, each family as shares of the text, is
trained on labelled rows, calibrated by Platt's sigmoid on rows that the training left out, and scored in Arrow
batches. A text is kept if it passes the counted rules and its calibrated probability reaches ``THRESHOLD``.

Null is an empty text: no words, so the counted rules fail it and its score is the calibrated probability of the
intercept. Ties don't arise (a probability equal to the threshold is kept); repeated rows are judged alike. A null id is kept and never
held out. A text of any length is scored whole, in one piece of its own; a labelled text beyond the fit's bytes doesn't teach. Without
labels, or with those of one class, every score is that of no or one class. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import arrow_map, labelled_texts
from foliograph.llm.structure import duplicate_lines, of_bytes, repeated_words, statistics
from foliograph.llm.textvec import Piece, characters, followed, lay, mix, rolling, word_hashes

WORD_BITS = 17
CHAR_BITS = 15
#: labelled texts of each class that a fit takes at most
PER_CLASS = 768
STEPS = 80
RATE = 0.5
L2 = 1e-7
#: calibrated probabilities of good quality from here on are kept
THRESHOLD = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def families(p: Piece, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each family's feature rows, and how many of them each text has; rows lie in the texts' order."""
    two, at = followed(hashes, p.word_doc, 2)
    out = [((h >> np.uint64(64 - WORD_BITS)).astype(np.int32) + k * (1 << WORD_BITS), np.bincount(d, minlength=p.n)) for k, (h, d) in enumerate(((hashes, p.word_doc), (two, p.word_doc[at])))]
    base = 2 << WORD_BITS
    chars, begin = characters(p)
    for k, n in enumerate((3, 4)):
        h = rolling(chars, n)
        row = (h >> np.uint64(64 - CHAR_BITS)).astype(np.int32) + (base + k * (1 << CHAR_BITS))
        inside = np.ones(len(h), bool)
        for back in range(1, n):  # windows that run into the next text
            cut = begin[1:] - back
            inside[cut[(cut >= 0) & (cut < len(h))]] = False
        which = np.repeat(np.arange(p.n), np.diff(begin))[: len(h)]
        out.append((row[inside], np.bincount(which[inside], minlength=p.n)))
    return out


ROWS = (2 << WORD_BITS) + (2 << CHAR_BITS)


def segment_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(counts)
    return (total[end] - total[end - counts]) / np.maximum(counts, 1)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, p: Piece, hashes: np.ndarray) -> np.ndarray:
        return self.bias + sum(segment_means(self.weight[rows], counts) for rows, counts in families(p, hashes))

    def score(self, p: Piece, hashes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(p, hashes) + self.shift, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the logits' sigmoid fit the labels, by Newton steps with Platt's smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        H = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(H, x.T @ (p - t) + 1e-3 * (w - [1, 0])), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Logistic regression by Adam on four fifths of the texts, calibrated on the fifth left out.

    With one class only every probability is near that class; with no text at all everything is kept.
    """
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(ROWS, np.float32), 30.0 if len(y) == 0 or y[0] else -30.0)
    rows, cols, vals = [], [], []
    for lo in range(0, len(texts), 64):
        p = lay(texts[lo : lo + 64])
        for ids, counts in families(p, word_hashes(p)):
            own = np.repeat(np.arange(p.n, dtype=np.int64) + lo, counts)
            key, n = np.unique(own << 32 | ids, return_counts=True)
            rows.append((key >> 32).astype(np.int32))
            cols.append((key & 0xFFFFFFFF).astype(np.int32))
            vals.append((n / counts[(key >> 32) - lo]).astype(np.float32))
    r, c, v = map(np.concatenate, (rows, cols, vals))
    train = np.arange(len(y)) % 5 != 4
    if y[train].min() == y[train].max() or y[~train].min() == y[~train].max():
        train[:] = True
    share = np.where(y > 0, 0.5 / max(y[train].sum(), 1), 0.5 / max((1 - y)[train].sum(), 1)) * train
    w, b = np.zeros(ROWS), 0.0
    m, s, mb, sb = np.zeros(ROWS), np.zeros(ROWS), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(r, weights=w[c] * v, minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, gb = np.bincount(c, weights=d[r] * v, minlength=ROWS) + L2 * w, d.sum()
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        mb += 0.1 * (gb - mb)
        sb += 0.01 * (gb * gb - sb)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        b -= 0.1 * RATE * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    z = np.bincount(r, weights=w[c] * v, minlength=len(y)) + b
    slope, shift = platt(z[~train], y[~train]) if not train.all() else (1.0, 0.0)
    return Model(w.astype(np.float32), b, slope, shift)


def judge(texts: list[bytes], model: Model) -> dict[str, np.ndarray]:
    p = lay(texts)
    hashes = word_hashes(p)
    counts, _ = statistics(texts, p, hashes)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    score = model.score(p, hashes)
    return counts | {"base_failed": failed, "kept": ~failed & (score >= THRESHOLD), "score": score}


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled_texts(docs, labels, "quality", per_class)
    return fit([t.encode() for t, _ in sample], np.array([y for _, y in sample]))


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: the counts, ``base_failed``, ``kept`` and the calibrated ``score``. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))  # 1.3 MB, whatever the corpus
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return arrow_map(docs, ["doc_id", "text"], schema, lambda texts: judge(texts, shared.value))
