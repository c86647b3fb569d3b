"""Passes over ordered rows, of groups of any size; and cutting lineage.

Groups of up to ``WHOLE`` rows are dealt by key, each one task's. Rows of larger ones are laid out in order over partitions by ranges of key and
order, so a large group is several partitions' work: each does its part, and what one hands on to the next is settled in between, from a few
values a partition. ``so_far`` does that for sums, maxima and last values in windows, ``running`` for groups of either size; ``in_order`` for any state
that moves from row to row, and ``counted`` for one that says of every row whether something begins there.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: the number of the partition that a row was laid in
PART = "__part"
#: rows of a group that one task takes
WHOLE = 100_000


def by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to ``WHOLE``, and those of larger ones: None if there are none. Larger groups are few, a row each is broadcast."""
    large = cut(rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WHOLE).drop("__n"))
    if large.isEmpty():
        return rows, None
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(F.broadcast(large), same, "left_anti"), rows.join(F.broadcast(large), same, "left_semi")


def by_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with each group in one partition, in order. As many tasks as shuffles have: what is done with a row takes longer than its bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)


def records(batch: pa.RecordBatch) -> Iterable[dict]:
    """The rows of a batch as dictionaries. Numbers without nulls are taken as a whole, which is much faster than one by one."""

    def values(c: pa.Array) -> list:
        whole = c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
        return c.to_numpy(zero_copy_only=False).tolist() if whole else c.to_pylist()

    names = batch.schema.names
    return (dict(zip(names, r, strict=True)) for r in zip(*map(values, batch.columns), strict=True))


def laid_out(rows: DataFrame, keys: list[str], order: list[str], falling: bool = False) -> DataFrame:
    """``rows`` sorted by keys and order over all partitions, with ``__part``; written, so that every pass meets the same parts."""
    by = [*(F.col(k).asc() for k in keys), *(F.col(o).desc() if falling else F.col(o).asc() for o in order)]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def torn(laid: DataFrame, keys: list[str]) -> list[tuple[int, int, bool]]:
    """Neighbouring parts that share a group, as ``part, next, whole``: whether that group is all that the next part has. One row a part comes to the driver."""
    ends = laid.groupBy(PART).agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
    parts = sorted(ends.collect(), key=lambda r: r[PART])
    return [(a[PART], b[PART], b["first"] == b["last"]) for a, b in zip(parts, parts[1:], strict=False) if a["last"] == b["first"]]


def group_of(laid: DataFrame, keys: list[str], parts: list[int], which: Callable[[Column], Column]) -> DataFrame:
    """The rows of the first (``F.min``) or last (``F.max``) group of each of ``parts``."""
    some = laid.where(F.col(PART).isin(parts))
    chosen = some.groupBy(F.col(PART).alias("p")).agg(which(F.struct(*keys)).alias("k"))  # a row a part
    same = [F.col(k).eqNullSafe(F.col(f"k.{k}")) for k in keys]
    return some.join(F.broadcast(chosen), [F.col(PART) == F.col("p"), *same], "left_semi")


def so_far(laid: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, last: dict[str, Column] | None = None, falling: bool = False) -> DataFrame:
    """The rows of ``laid_out`` with the sum, maximum and last value that isn't null of the rows before each in its group: null if there are none.

    Windows are over the parts of a group. What a part adds to what came before is a row for each group that is torn, fewer than two
    for each part, and is broadcast. ``keys``, ``order`` and ``falling`` are those that the rows were laid out by.
    """
    sums, most, last = sums or {}, most or {}, last or {}
    edge = F.min if falling else F.max
    by = [F.col(o).desc() if falling else F.col(o).asc() for o in order]
    inside = Window.partitionBy(PART, *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.max(c).over(inside) for n, c in most.items()} | {n: F.last(c, ignorenulls=True).over(inside) for n, c in last.items()})
    shared = torn(laid, keys)
    if not shared:
        return rows
    own = {n: F.sum(c) for n, c in sums.items()} | {n: F.max(c) for n, c in most.items()} | {n: edge(F.when(c.isNotNull(), F.struct(*order, c.alias("value")))) for n, c in last.items()}
    met = group_of(laid, keys, [a for a, _, _ in shared], F.max)
    ended = met.groupBy(PART, *keys).agg(*(c.alias(n) for n, c in own.items()))
    follows = F.create_map(*(F.lit(x) for a, b, _ in shared for x in (a, b)))
    # what each part that goes on leaves to the next, with all that comes before it
    before = Window.partitionBy(*keys).orderBy(PART)
    totals = {n: F.sum(n).over(before) for n in sums} | {n: F.max(n).over(before) for n in most} | {n: F.last(F.col(f"{n}.value"), ignorenulls=True).over(before) for n in last}
    carried = ended.select(follows[F.col(PART)].alias("p"), *(F.col(k).alias(f"__{k}") for k in keys), *(c.alias(f"__{n}") for n, c in totals.items()))
    joined = rows.join(F.broadcast(carried), [F.col(PART) == F.col("p"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)], "left")
    both = {n: F.when(F.col(n).isNull() | F.col(f"__{n}").isNull(), F.coalesce(n, f"__{n}")).otherwise(F.col(n) + F.col(f"__{n}")) for n in sums} | {n: F.greatest(n, f"__{n}") for n in most} | {n: F.coalesce(n, f"__{n}") for n in last}
    return joined.withColumns(both).select(*rows.columns)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, last: dict[str, Column] | None = None, falling: bool = False) -> DataFrame:
    """``rows`` with what ``so_far`` gives, whatever the size of their groups."""
    few, many = by_size(rows, keys)
    by = [F.col(o).desc() if falling else F.col(o).asc() for o in order]
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    named = {n: F.sum(c).over(before) for n, c in (sums or {}).items()} | {n: F.max(c).over(before) for n, c in (most or {}).items()} | {n: F.last(c, ignorenulls=True).over(before) for n, c in (last or {}).items()}
    out = few.withColumns(named)
    return out if many is None else out.unionByName(so_far(laid_out(many, keys, order, falling), keys, order, sums, most, last, falling).drop(PART))


def handed_on(laid: DataFrame, keys: list[str], state: Callable[[], Any], move: Callable[[Any, dict], Any]) -> tuple[dict[int, int], dict[int, bytes]]:
    """The part that goes on with the last group of each part, and the state, pickled, that it begins with.

    First each part that hands a group on runs it from a new state; then those that get another state than they assumed run again, until none
    does. A state that soon depends on its last rows alone is settled in the second round, however large the group; one that never forgets takes
    a round a part. States go through the driver, one for each part that hands a group on: they should be small.
    """
    shared = torn(laid, keys)
    follower = {a: b for a, b, _ in shared}
    passing = {b for _, b, whole in shared if whole and b in follower}
    coming: dict[int, bytes] = {}

    def settled(batches):
        """The state that each part's last group ends with."""
        part, held = None, None
        for batch in batches:
            for row in records(batch):
                if row[PART] != part:
                    if part is not None:
                        yield pa.RecordBatch.from_pydict({"part": [part], "state": [pickle.dumps(held)]})
                    part = row[PART]
                    held = pickle.loads(coming[part]) if part in coming and part in passing else state()
                move(held, row)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "state": [pickle.dumps(held)]})

    todo = sorted(follower)
    while todo:
        ended = group_of(laid, keys, todo, F.max).mapInArrow(settled, "part long, state binary").collect()
        todo = []
        for r in ended:
            after = follower[r.part]
            if coming.get(after) != r.state:
                coming[after] = bytes(r.state)
                if after in passing:
                    todo.append(after)
    return follower, coming


def in_order(rows: DataFrame, keys: list[str], order: list[str], schema: str, state: Callable[[], Any], step: Callable[[Any, dict], Iterable[tuple]], last: Callable[[Any], Iterable[tuple]] | None = None, light: bool = False) -> DataFrame:
    """Each group's rows through ``step(state, row)`` in order; what it gives becomes rows of ``schema``.

    Groups of up to ``WHOLE`` rows are one task's. Parts of a larger one are done side by side, from the states that ``handed_on`` settles.
    Memory holds one state and one Arrow batch. ``last(state)`` gives what a group ends with. An empty table gives no row. Rows are written before
    they are counted and dealt; not if they are ``light``, which is to say that making them twice takes less time than that.
    """
    few, many = by_size(rows if light else cut(rows), keys)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind.type) for k, kind in enumerate(kinds)], schema=kinds)

    def passed(follower: dict[int, int], coming: dict[int, bytes]):
        def run(batches):
            now, held, part = None, None, None
            for batch in batches:
                out: list[tuple] = []
                for row in records(batch):
                    key, at = tuple([row[k] for k in keys]), row.get(PART)
                    if now is None or key != now or at != part:
                        if now is not None and last is not None and (at == part or part not in follower):
                            out += last(held)
                        goes_on = at != part and at in coming
                        now, part = key, at
                        held = pickle.loads(coming[part]) if goes_on else state()
                    out += step(held, row)
                yield made(out)
            if now is not None and last is not None and part not in follower:
                yield made([*last(held)])

        return run

    done = by_group(few, keys, order).mapInArrow(passed({}, {}), schema)
    if many is None:
        return done
    laid = laid_out(many, keys, order)
    return done.unionByName(laid.mapInArrow(passed(*handed_on(laid, keys, state, lambda held, row: [*step(held, row)])), schema))


def counted(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], name: str, state: Callable[[], Any], step: Callable[[Any, dict], int]) -> DataFrame:
    """``rows`` with ``name``, how many rows of the group, each one itself included, ``step(state, row)`` has given 1 for (else 0). It sees keys and
    ``uses`` alone; other columns stay outside Python. The count isn't part of the state, which a large group's parts hand on."""
    few, many = by_size(cut(rows), keys)

    def marked(coming: dict[int, bytes], total: bool):
        def run(batches):
            now, held, part, n = None, None, None, 0
            for batch in batches:
                marks = []
                for row in records(batch.select([c for c in batch.schema.names if c in (*keys, *uses, PART)])):
                    key, at = tuple([row[k] for k in keys]), row.get(PART)
                    if now is None or key != now or at != part:
                        goes_on = at != part and at in coming
                        now, part, n = key, at, 0
                        held = pickle.loads(coming[part]) if goes_on else state()
                    n = n + step(held, row) if total else step(held, row)
                    marks.append(n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, name])

        return run

    schema = lambda df: StructType([*df.schema.fields, StructField(name, LongType())])
    done = by_group(few, keys, order).mapInArrow(marked({}, True), schema(few))
    if many is None:
        return done
    laid = laid_out(many, keys, order)
    _, coming = handed_on(laid, keys, state, step)
    summed = so_far(cut(laid.mapInArrow(marked(coming, False), schema(laid))), keys, order, sums={"__before": F.col(name)})
    return done.unionByName(summed.withColumn(name, F.coalesce("__before", F.lit(0)) + F.col(name)).drop("__before", PART))


def shared_folder(session) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local master gets one of its own."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
