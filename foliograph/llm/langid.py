"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed against each
automaton: a phrase is the longest match from where the last one ended, a letter that the sample lacks is a phrase
of its own; it may be as long as the text. Phrases times log2 of the sample's length, over the text's length, estimate the cross entropy; the
language with the least wins, the first in alphabetical order among equals.

Texts are lower-cased; every run of characters that aren't letters is one space. Whole texts are parsed side by side, in
rounds of ``CHUNK`` characters; each text's place in each automaton is carried from round to round. Null texts and texts without a letter are ``und``
with score 0, and so is everything where nothing was learned. A text of any length is parsed whole. Repeated rows are
labelled alike; a null id stays null. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed, each_text, held_out, lean, pieces

#: labelled texts a language, and characters of them together, that a fit takes at most; languages that it learns at most
TEXTS = 64
CHARACTERS = 1 << 15
LANGUAGES = 256
CHUNK = 256
#: how steeply the score falls with the difference in entropy, in nats a bit
STEEP = 4.0
_POINTS = 0x110000


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton as a table: row = state, column = symbol, 0 = no transition, root = row 0."""
    following: list[list[int]] = [[0] * alphabet]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        state = len(following)
        following.append([0] * alphabet)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and not following[p][c]:
            following[p][c] = state
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(following)
                following.append(following[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p][c] == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return np.array(following, np.int32)


class Parser:
    """The automata of some languages, and the parse of texts against all of them."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.letters = letters()
        spoken = [self.squeeze(code_points(samples[x])) for x in self.names]
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *spoken]))
        known = known[known > 0]  # 0 stands for a space
        self.symbol = np.zeros(_POINTS, np.int32)
        self.symbol[:] = len(known) + 1  # a letter in no sample
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.symbol[0] = 0
        self.width = len(known) + 2
        self.tables = [automaton(self.symbol[s].tolist(), self.width).ravel() for s in spoken]
        self.table = np.concatenate([np.zeros(0, np.int32), *self.tables])
        self.base = np.cumsum([0, *(len(t) // self.width for t in self.tables)])[:-1]  # each automaton's root in the joint table
        self.bits = [np.log2(max(len(s), 2)) for s in spoken]

    def squeeze(self, points: np.ndarray) -> np.ndarray:
        """Letters as they are and 0 for each run of other characters."""
        kept = np.where(self.letters[points], points, 0)
        return kept[np.concatenate([[True], (kept[1:] > 0) | (kept[:-1] > 0)])] if len(kept) else kept

    def phrases(self, table: np.ndarray, steps: np.ndarray, lengths: np.ndarray, state: np.ndarray | None = None, base: np.ndarray | int = 0) -> np.ndarray:
        """Phrases that begin in each column; ``steps`` has a row for each position and columns by falling length.

        ``state`` is where each column's parse stands and moves on with it, ``base`` the root of each column's automaton."""
        count = np.zeros(steps.shape[1], np.int64)
        state = np.zeros(steps.shape[1], np.int64) if state is None else state
        root = np.broadcast_to(np.asarray(base) * self.width, state.shape)
        live = np.searchsorted(-lengths, -np.arange(len(steps)), "left")  # columns longer than each position
        for at, n in enumerate(live):
            c = steps[at, :n] + root[:n]
            s = state[:n]
            to = table[s * self.width + c]
            count[:n] += (to == 0) | (s == 0)
            state[:n] = np.where(to == 0, table[c], to)
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, score
        rows = [self.squeeze(code_points(t)) for t in texts]
        size = np.array([len(r) for r in rows])
        spoken = np.array([bool(r.any()) for r in rows])
        if not spoken.any():
            return names, score
        order = np.argsort(-size, kind="stable")
        of, falling = len(self.names), size[order]
        count, state = np.zeros(len(texts) * of, np.int64), np.zeros(len(texts) * of, np.int64)
        for begin in range(0, int(falling[0]), CHUNK):
            n = int(np.searchsorted(-falling, -begin, "left"))  # texts longer than what is parsed
            lengths = np.minimum(falling[:n] - begin, CHUNK)
            grid = np.zeros((n, CHUNK), np.int32)
            grid[np.arange(CHUNK)[None, :] < lengths[:, None]] = self.symbol[np.concatenate([rows[i][begin : begin + CHUNK] for i in order[:n]])]
            count[: n * of] += self.phrases(self.table, np.repeat(grid.T, of, axis=1), np.repeat(lengths, of), state[: n * of], np.tile(self.base, n))
        entropy = np.zeros((len(texts), of))
        entropy[order] = count.reshape(-1, of) * np.array(self.bits)
        entropy /= np.maximum(size, 1)[:, None]
        best = entropy.argmin(1)
        likely = np.exp(STEEP * (entropy.min(1)[:, None] - entropy))
        sure = 1 / likely.sum(1)
        for i in np.flatnonzero(spoken):
            names[i] = self.names[best[i]]
        return names, np.where(spoken, sure, 0.0)


@lru_cache(2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def learn(docs: DataFrame, texts: int = TEXTS) -> tuple[tuple[str, str], ...]:
    """A sample of each language's text: whole texts of ``texts`` rows at most, spread by hash, ``CHARACTERS`` characters together. A text that
    doesn't fit is left out, unless none does: then the shortest is taken. More than ``LANGUAGES`` values of ``lang`` are an error."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    ids = checkpointed(known.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(texts)).alias("slot")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang"))
    if ids.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values; an automaton each would not fit into a worker")
    # LANGUAGES * texts rows at most: a proven bound for the broadcast and for the sizes that come back
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    one = checkpointed(rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")))
    sizes = one.select("lang", "doc_id", F.length("text").alias("size"), F.xxhash64("doc_id").alias("turn")).collect()
    taken: dict[str, list[int]] = {}
    room: dict[str, int] = {}
    for r in sorted(sizes, key=lambda r: (r.lang, r.turn, r.doc_id)):
        if r.size <= room.setdefault(r.lang, CHARACTERS):
            room[r.lang] -= r.size
            taken.setdefault(r.lang, []).append(r.doc_id)
    for r in sorted(sizes, key=lambda r: (r.size, r.doc_id)):
        taken.setdefault(r.lang, [r.doc_id])
    chosen = docs.sparkSession.createDataFrame([(x, i) for x, own in taken.items() for i in own], "lang string, doc_id long")
    found: dict[str, list[str]] = {}
    for r in sorted(one.join(F.broadcast(chosen), ["lang", "doc_id"]).collect(), key=lambda r: (r.lang, r.doc_id)):
        found.setdefault(r.lang, []).append(r.text)
    return tuple((lang, "\n".join(parts)) for lang, parts in sorted(found.items()))


def language(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, texts))

    def run(batches):
        for batch in batches:
            of = parser(shared.value)
            names, scores = [], []
            for piece in pieces(each_text(batch), 1 << 21):
                found, score = of.predict([x.decode("utf-8", "replace") for x in piece])
                names += found
                scores += score.tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    done = docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
