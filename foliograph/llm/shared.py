"""Spark plumbing that the training-data operators share.

Tables are read and cut through Spark only, so every path that Spark can open works. Lineage is cut
with ``checkpoint()`` in the shared folder that the session names; executors may be lost at any time.
"""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at a time; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 19
#: Rows of an Arrow batch that become Python objects at a time.
ROWS_AT_ONCE = 64
#: Rows up to which a list of ids (16 bytes each) is sent to every executor; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bytes of labelled texts of each class that a fit takes to the driver at most; the texts stay whole.
FIT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that the session names in spark.checkpoint.dir.

    Without one a local master gets a folder of its own; on a cluster it is an error, since executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def is_held_out(doc_id: int, modulus: int, remainder: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def spread_ids(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` ids of each group, spread by hash: one a slot, the smallest. Counts combine before the shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(most))
    return rows.groupBy(group, slot.alias("slot")).agg(F.min("doc_id").alias("doc_id")).drop("slot")


def only_ids(docs: DataFrame, ids: DataFrame, rows: int, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` with (or, by ``left_anti``, without) an id in ``ids``, which has ``rows`` distinct ids.

    The ids are broadcast only when that count is within ``BROADCAST_IDS``; any larger list is joined by a shuffle.
    """
    return docs.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids.hint("merge"), "doc_id", how)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts for a fit: of each class ``per_class`` rows and ``FIT_BYTES`` bytes at most, in a stable
    order. Texts are taken whole, by their hash; one that doesn't fit into the bytes left is left out alone, and the next is tried.

    Rows whose crc32(doc_id) is 0 modulo 5 are held out. Null labels and ids do not teach; of several labels of
    one id the largest counts, of several texts the smallest. Null texts are empty ones.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = spread_ids(known, "label", per_class)
    # two classes, so 2 * per_class rows at most: a proven bound for the broadcast and for what comes back
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = checkpointed(joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    sizes = one.select("doc_id", "label", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("turn")).collect()
    room: dict[int, int] = {}
    fitting = []
    for r in sorted(sizes, key=lambda r: (r.label, r.turn, r.doc_id)):
        left = room.setdefault(r.label, FIT_BYTES)
        if r.size <= left:
            room[r.label] = left - r.size
            fitting.append(r.doc_id)
    rows = one.where(F.col("doc_id").isin(fitting)).select("doc_id", "text", "label").collect() if fitting else []
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)]


def each_text(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The batch's texts as UTF-8, one after the other; null is empty. Only a few rows are Python objects at a time."""
    texts = batch.column(column).cast(pa.binary())
    for lo in range(0, len(texts), ROWS_AT_ONCE):
        yield from (x or b"" for x in texts.slice(lo, ROWS_AT_ONCE).to_pylist())


def binary_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8; null is empty."""
    return [*each_text(batch, column)]


@lru_cache(1)
def allocator() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that is used again: what a partition freed goes back to the system after it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (libc := allocator()) is not None:
                libc.malloc_trim(0)

    return go


def pieces(texts: Iterable[bytes], most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive runs of whole texts of about ``most`` bytes."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield run


def arrow_map(docs: DataFrame, columns: list[str], schema: str, score) -> DataFrame:
    """``docs`` with each Arrow batch's ``columns`` replaced by what ``score(texts)`` returns besides the kept ids.

    ``score`` takes a list of UTF-8 texts and returns a dict of arrays, one value a text.
    """
    kept = [c for c in columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: dict[str, list] = {}
            for piece in pieces(each_text(batch)):
                for name, values in score(piece).items():
                    done.setdefault(name, []).extend(values.tolist() if hasattr(values, "tolist") else values)
            if batch.num_rows:
                fields = {c: batch.column(c) for c in kept} | {k: pa.array(v) for k, v in done.items()}
                yield pa.RecordBatch.from_pydict(fields)

    return docs.select(*columns).mapInArrow(lean(run), schema)
