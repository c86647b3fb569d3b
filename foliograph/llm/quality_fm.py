"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every text is a sparse vector x of hashed word counts (scaled to length 1), standardised structure statistics and
the logarithm of its length in characters as metadata. The score is
``w0 + <w, x> + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]``, whose second part is all pairwise
interactions through vectors of rank ``RANK`` in time linear in the text, and a logistic link.

Null and empty texts have statistics of 0 and no words; they are scored by intercept and length alone. Labels,
language, source and id are never inputs. A text of any length is scored whole. Repeated rows are scored alike, each by
itself; a null id stays null. An empty table gives no row. Other columns are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import arrow_map, each_text, held_out, labelled_texts, lean, pieces
from foliograph.llm.structure import STATISTICS, statistics
from foliograph.llm.textvec import lay, word_hashes

WORD_BITS = 16
RANK = 4
#: labelled texts of each class that a fit takes at most
PER_CLASS = 768
STEPS = 150
RATE = 0.05
THRESHOLD = 0.3
N_DENSE = len(STATISTICS) + 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense matrix, and the sparse words as (text, row, value) with one entry for each distinct row of a text."""
    p = lay(texts)
    hashes = word_hashes(p)
    _, dense = statistics(texts, p, hashes)
    size = np.array([np.log1p(len(t)) for t in texts])  # metadata: the text's size
    key = np.sort(p.word_doc.astype(np.int64) << 32 | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    doc, row = (key[first] >> 32), key[first] & 0xFFFFFFFF
    norm = np.sqrt(np.bincount(doc, weights=n.astype(float) ** 2, minlength=p.n))
    return np.concatenate([dense, size[:, None]], 1), doc, row, n / norm[doc] if len(n) else n.astype(float)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    w0: float
    wd: np.ndarray
    vd: np.ndarray
    ww: np.ndarray
    vw: np.ndarray

    def logit(self, dense, doc, row, x) -> np.ndarray:
        d = np.clip((dense - self.mean) / self.spread, -8, 8)
        n = len(d)
        linear = self.w0 + d @ self.wd + np.bincount(doc, weights=self.ww[row] * x, minlength=n)
        pairs = np.zeros(n)
        for f in range(RANK):
            vx = self.vw[f, row] * x
            s = d @ self.vd[f] + np.bincount(doc, weights=vx, minlength=n)
            pairs += s * s - (d * d) @ (self.vd[f] ** 2) - np.bincount(doc, weights=vx * vx, minlength=n)
        return linear + pairs / 2

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*features(texts)), -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model:
    """All parameters by Adam on the logistic loss, both classes weighing the same.

    With one class only every score is near that class; with no text at all everything is kept.
    """
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    size = 1 << WORD_BITS
    m = Model(np.zeros(N_DENSE), np.ones(N_DENSE), 0.0, np.zeros(N_DENSE), rng.normal(0, 0.02, (RANK, N_DENSE)), np.zeros(size), rng.normal(0, 0.02, (RANK, size)))
    if len(y) == 0 or y.min() == y.max():
        m.w0 = 30.0 if len(y) == 0 or y[0] else -30.0
        m.vd[:] = m.vw[:] = 0
        return m
    parts = [features(texts[lo : lo + 64]) for lo in range(0, len(texts), 64)]
    dense = np.concatenate([x[0] for x in parts])
    doc = np.concatenate([x[1] + 64 * k for k, x in enumerate(parts)])
    row, x = (np.concatenate([q[k] for q in parts]) for k in (2, 3))
    m.mean, m.spread = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    d = np.clip((dense - m.mean) / m.spread, -8, 8)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w0 = np.zeros(1)
    parameters = [w0, m.wd, m.vd, m.ww, m.vw]
    moments = [(np.zeros_like(q), np.zeros_like(q)) for q in parameters]
    for step in range(1, STEPS + 1):
        m.w0 = float(w0[0])
        g = (1 / (1 + np.exp(-np.clip(m.logit(dense, doc, row, x), -30, 30))) - y) * share
        gx = g[doc] * x
        gvd, gvw = np.empty_like(m.vd), np.empty_like(m.vw)
        for f in range(RANK):
            s = d @ m.vd[f] + np.bincount(doc, weights=m.vw[f, row] * x, minlength=len(y))
            gvd[f] = (g * s) @ d - (g @ (d * d)) * m.vd[f] + 1e-3 * m.vd[f]
            gvw[f] = np.bincount(row, weights=gx * (s[doc] - m.vw[f, row] * x), minlength=size) + 1e-5 * m.vw[f]
        grads = [np.array([g.sum()]), g @ d + 1e-3 * m.wd, gvd, np.bincount(row, weights=gx, minlength=size) + 1e-5 * m.ww, gvw]
        for q, dq, (a, b) in zip(parameters, grads, moments, strict=True):
            a += 0.1 * (dq - a)
            b += 0.01 * (dq * dq - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m.w0 = float(w0[0])
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled_texts(docs, labels, "quality", per_class)
    return fit([t.encode() for t, _ in sample], np.array([y for _, y in sample]))


def quality_classifier(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))  # 3 MB, whatever the corpus
    scored = arrow_map(docs, ["doc_id", "text"], "doc_id long, score double", lambda texts: {"score": shared.value.score(texts)})
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all their columns and types as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))

    def run(batches):
        for batch in batches:
            score = [s for piece in pieces(each_text(batch)) for s in shared.value.score(piece)]
            yield batch.filter(pa.array(s >= threshold for s in score))

    return docs.mapInArrow(lean(run), docs.schema)
