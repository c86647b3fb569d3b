"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams of 3 to 5 bytes, its edges included, so a misspelling that was never
seen shares most of its vectors with the word that was. A passage is a run of ``PASSAGE`` words; its n-gram
embeddings are averaged, and a softmax over two classes reads the average. A text's probability is that of at least
one toxic passage, 1 - prod(1 - p), so a few words in a very long text are not averaged away, and embeddings and
softmax learn jointly from the texts' labels through that product.

A product over passages rises with a text's length, which averaging over the whole text would not; averaging however
loses two toxic words among twenty thousand clean ones. The bias of a passage is learned jointly, so that long clean
texts of the sample pull it down.

Null and empty texts have no passage: their score is 0. A text of any length is scored whole, in one piece of its own.
Ties and repeated rows are scored alike, each on its own; a null id stays null. Without labels, or with those of one
class, every score is that of no or one class. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import arrow_map, held_out, labelled_texts
from foliograph.llm.textvec import SPACE, lay

NGRAMS = (3, 4, 5)
BUCKET_BITS = 18
PASSAGE = 2
#: texts of the sample that an n-gram must occur in to be learned: one in so many of the smaller class, three at least
ONE_IN = 64
LEAST_TEXTS = 3
DIM = 8
STEPS = 40
RATE = 0.15
#: what a passage's log-odds start at: most passages of a toxic text are clean
BIAS = -4.0
#: labelled texts of each class that a fit takes at most
PER_CLASS = 512


_SEED = np.random.default_rng(3).integers(1, 1 << 32, 256, dtype=np.uint32)
_NONE = 1 << BUCKET_BITS  # the row of what is no n-gram of a word; its weight is 0


def subwords(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n-gram length the embedding row at every byte, the first byte of each passage, its text."""
    p = lay(texts, lower=True)
    buf = np.concatenate([np.full(1, 32, np.uint8), np.where(SPACE[p.buf], np.uint8(32), p.buf)])
    if not len(p.word_start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(p.word_doc, np.arange(p.n))[p.word_doc]
    opens = (np.arange(len(p.word_doc)) - first) % PASSAGE == 0
    space = buf == 32
    v = _SEED[buf]
    rows = []
    h, inner = v, None
    for n in range(2, NGRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + v[n - 1 :]  # of the n bytes from each place on
        inner = space[1 : len(h) + 1] & (n > 2) if inner is None else inner[:-1] | space[n - 2 : n - 2 + len(h)]
        if n in NGRAMS:
            at = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
            row = np.full(len(buf), _NONE, np.int32)
            row[: len(h)] = np.where(inner, _NONE, at.view(np.int32))
            rows.append(row)
    return rows, p.word_start[opens], p.word_doc[opens]


@dataclass
class Model:
    """``weight``: each n-gram's embedding seen through the softmax (the difference of its two log-odds)."""

    weight: np.ndarray
    known: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, start, text = subwords(texts)
        if not len(text):
            return np.zeros(len(texts))
        total = sum(np.add.reduceat(self.weight[r], start) for r in rows)
        n = sum(np.add.reduceat((self.known[r]).view(np.uint8), start, dtype=np.int32) for r in rows)
        z = total / np.maximum(n, 1) + self.bias
        clean = -np.logaddexp(0, np.clip(z, -30, 30))  # log(1 - p)
        return np.clip(-np.expm1(np.bincount(text, weights=clean, minlength=len(texts))), 0, 1)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax, fitted together by Adam on all given texts; both classes weigh the same.

    With one class only, or nothing, every score is that class (0 for nothing).
    """
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(_NONE + 1, np.float32), np.zeros(_NONE + 1, bool), 30.0 if len(y) and y[0] else -30.0)
    grams, start, text = subwords(texts)
    passage = np.zeros(len(grams[0]), np.int32)
    passage[start[1:]] = 1
    passage = np.cumsum(passage, dtype=np.int32)
    # an n-gram is learned where several texts have it; others say nothing, in the fit and later
    pairs = np.concatenate([np.unique(text[passage[g < _NONE]].astype(np.int64) << 20 | g[g < _NONE]) for g in grams])
    known = np.zeros(_NONE + 1, bool)
    known[:_NONE] = np.bincount(np.unique(pairs) & (1 << 20) - 1, minlength=_NONE)[:_NONE] >= max(LEAST_TEXTS, int(min(y.sum(), (1 - y).sum())) // ONE_IN)
    rows = np.concatenate([g[known[g]] for g in grams])
    owner = np.concatenate([passage[known[g]] for g in grams])
    used, rows = np.unique(rows, return_inverse=True)
    n = np.maximum(np.bincount(owner, minlength=len(text)), 1)
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (len(used), DIM))
    W = rng.normal(0, 0.5, (DIM, 2))
    b = np.array([0.0, BIAS])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (E, W, b)]
    for step in range(1, STEPS + 1):
        through = W[:, 1] - W[:, 0]
        z = np.bincount(owner, weights=(E @ through)[rows], minlength=len(text)) / n + b[1] - b[0]
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(text, weights=-np.logaddexp(0, z), minlength=len(y))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d loss / d z of a passage: p for a clean text, -p (1 - P) / P for a toxic one
        d = p * np.where(y > 0, -(1 - toxic) / toxic, 1.0)[text] * share[text]
        per_row = np.bincount(rows, weights=(d / n)[owner], minlength=len(used))
        grad = E.T @ per_row
        grads = [np.outer(per_row, through) + 1e-7 * E, np.stack([-grad, grad], 1) + 1e-5 * W, np.array([-d.sum(), d.sum()])]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for x, g, (m, v) in zip((E, W, b), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weight = np.zeros(_NONE + 1, np.float32)
    weight[used] = E @ (W[:, 1] - W[:, 0])
    return Model(weight, known, float(b[1] - b[0]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled_texts(docs, labels, "toxic", per_class)
    return fit([t.encode() for t, _ in sample], np.array([y for _, y in sample]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))  # 1 MB, whatever the corpus
    scored = arrow_map(docs, ["doc_id", "text"], "doc_id long, score double", lambda texts: {"score": shared.value.score(texts)})
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
