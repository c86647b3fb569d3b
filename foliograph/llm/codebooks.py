"""Vector code compression: each part of a vector becomes the number of the nearest entry of that part's codebook.

Codebooks are integers and of a fixed size, so they are broadcast. An Arrow batch becomes one integer matrix; the distances of a
part to all entries are its square, less twice an exact int64 matrix product, plus the entries' squares; the first smallest
counts. In each round a task gives, for every entry, place and so on, the sum and count of what it assigned; a shuffle adds
them up, and only those ``parts * entries * place`` sums come to the driver, which makes the next codebook.

Vectors that are null or hold null or non-finite components are dropped. The width is that of the kept vector of the smallest id; vectors
of another width can't be compared and are dropped too, as are all if that width is not a positive multiple of the number of parts. Of equal
ids the smaller vectors come first in the first codebook; repeated rows are rows. With fewer rows than entries a codebook has as many
entries as rows. Components whose integer is so large that a sum of squares leaves 64 bits are taken as the largest that doesn't;
an error summed over a label that leaves 64 bits is null. Null ids are kept, their vectors come first. Empty tables give empty
results; columns other than ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed, lean

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: vectors that are compared at a time
VECTORS_AT_ONCE = 4096
#: labels up to which their sums are broadcast; beyond it they are joined by a shuffle in which each label is dealt to SALTS tasks
BROADCAST_LABELS, SALTS = 100_000, 32

OUT = "vec_id long, label int, code string, error long"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component."""
    most = float(math.isqrt((1 << 61) // max(vectors.shape[1], 1)))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest entry, the lowest of equal ones, and the squared distance."""
    squares = (part * part).sum(1)[:, None] - 2 * (part @ codebook.T) + (codebook * codebook).sum(1)[None, :]
    code = squares.argmin(1)
    return code, squares[np.arange(len(part)), code]


class Codebooks:
    """Integer codebooks of ``parts`` equal parts: an array of part, entry and place."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE) -> None:
        self.entries, self.scale = entries, scale
        self.parts, _, self.size = entries.shape
        self.width = self.parts * self.size

    @classmethod
    def first(cls, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
        """The parts of the ``entries`` smallest ids; None if no vector can be cut."""
        order = [F.col("vec_id").asc_nulls_first(), F.col("embedding")]
        head = vectors.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
        if not head or not head[0].embedding or len(head[0].embedding) % parts:
            return None
        width = len(head[0].embedding)
        rows = vectors.select("vec_id", "embedding").where(F.size("embedding") == width).orderBy(*order).limit(entries).collect()
        return cls(integers(np.array([r.embedding for r in rows], np.float64), scale).reshape(len(rows), parts, -1).transpose(1, 0, 2), scale)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``low, part, rows, codes, squared distances`` of the batch's vectors, some thousands at a time."""
        for low in range(0, batch.num_rows, VECTORS_AT_ONCE):
            whole = integers(matrix(batch.column("embedding").slice(low, VECTORS_AT_ONCE), self.width), self.scale)
            for part in range(self.parts):
                rows = whole[:, part * self.size : (part + 1) * self.size]
                yield low, part, rows, *nearest(rows, self.entries[part])

    def refined(self, vectors: DataFrame) -> Codebooks:
        """Each entry the mean of its parts, rounded down; those without any stay."""
        context = vectors.sparkSession.sparkContext
        sent = context.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            sums, counts = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
            for batch in batches:
                for _, part, rows, codes, _ in books.assigned(batch):
                    np.add.at(sums[part], codes, rows)
                    counts[part] += np.bincount(codes, minlength=counts.shape[1])
            part, entry, place = np.indices(sums.shape)
            used = counts[part, entry] > 0
            yield pa.RecordBatch.from_pydict({"part": part[used], "entry": entry[used], "place": place[used], "total": sums[used], "rows": counts[part, entry][used]})

        sums = vectors.select("embedding").mapInArrow(lean(run), "part long, entry long, place long, total long, rows long")
        entries = self.entries.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")).collect():
            entries[r.part, r.entry, r.place] = int(r.total) // r.rows
        sent.destroy()
        return Codebooks(entries, self.scale)

    def coded(self, vectors: DataFrame) -> DataFrame:
        """``vec_id, label, code, error`` of every vector."""
        sent = vectors.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            for batch in batches:
                codes, errors = np.zeros((batch.num_rows, books.parts), np.int64), np.zeros(batch.num_rows, np.int64)
                for low, part, rows, code, error in books.assigned(batch):
                    codes[low : low + len(rows), part] = code
                    errors[low : low + len(rows)] += error
                texts = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
        return vectors.select("vec_id", "label", "embedding").mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")

    def decoded(self, codes: DataFrame) -> DataFrame:
        """``codes`` with ``vector``: the components that each code stands for, as they were before scaling."""
        entries = F.array(*(F.array(*(F.array(*(F.lit(float(x) / self.scale) for x in entry)) for entry in part)) for part in self.entries.tolist()))
        parts = [entries[k][F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")] for k in range(self.parts)]
        return codes.withColumn("vector", F.concat(*parts))


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors of ``usable``."""
    books = Codebooks.first(vectors, parts, entries, scale)
    if books is None:
        return None
    vectors = vectors.where(F.size("embedding") == books.width)
    for _ in range(rounds):
        books = books.refined(vectors)
    return books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels, nulls together."""
    named = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = checkpointed(named.groupBy("__label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        return named.join(F.broadcast(totals), "__label").drop("__label")
    salted = named.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    totals = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(totals.hint("merge"), ["__label", "__salt"]).drop("__label", "__salt")


def compressed(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector."""
    kept = usable(vectors.select("vec_id", "embedding", "label"))
    books = fitted(kept)
    if books is None:
        return kept.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = checkpointed(books.coded(kept.where(F.size("embedding") == books.width)))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in DuckDB for tables with ``ENTRIES`` usable vectors of 64 components: each round is two tables."""
    size = 64 // PARTS
    found = lambda k: f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(p.v) AS v, arg_min(b.entry, (list_sum(list_transform(range(1, {size + 1}), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))), b.entry)) AS entry,
         min(list_sum(list_transform(range(1, {size + 1}), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))) AS error
  FROM parts p JOIN book{k} b USING (part) GROUP BY vec_id, part)"""  # noqa: E731
    means = ", ".join(f"((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, size + 1))
    steps = "".join(f"""{found(k)},
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT part, entry, [{means}] AS v FROM near{k} GROUP BY part, entry) m USING (part, entry)),""" for k in range(ROUNDS))  # noqa: E501
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * {size} + 1 : part * {size} + {size}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),{steps}{found(ROUNDS)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE = oracle()
