"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

1. Tokens (words) are counted by source; a source's share is its part of all tokens.
2. Weights are shares to the power of an exponent between 0 (all sources alike) and 1 (as they are), normalised. The
   smallest exponent is taken at which no source repeats more than ``MAX_REPEATS`` times and the weights' entropy
   doesn't exceed the target, if one is given. It is bisected on a grid of ``2 ** GRID_BITS`` steps, ``FAN`` exponents at a
   time, as aggregates over the table of sources; only the chosen step comes back to the driver.
3. The budget is the least at which every token is drawn once: the source that repeats least is drawn exactly once.
   A source's budget is its weight's part. It is drawn in epochs: each epoch is a new permutation of the source's
   blocks and of the documents within each block, and the last epoch stops at the document that fills the budget.

Blocks hold about ``BLOCK`` documents whatever the source's size, so a source with a third of all rows is many
blocks; running sums go over blocks first and then within each, never over a whole source in one task.
Only DataFrame functions are used.

Null sources are a source of their own. Texts without words count one token, so that every row is drawn. Equal ids
of a source take turns by their text's digest. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed

MAX_REPEATS = 2.0
GRID_BITS = 16
FAN = 16
#: rows a block, on average
BLOCK = 4096
#: rows up to which the table of sources is broadcast
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text; 1 if there is none."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")


def shares(counted: DataFrame) -> DataFrame:
    """``source, rows, n, p`` of every source: its rows, tokens and share."""
    sources = checkpointed(counted.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("n")))
    total = sources.agg(F.sum("n").alias("total"))  # one row
    return sources.crossJoin(F.broadcast(total)).select("source", "rows", "n", (F.col("n") / F.col("total")).alias("p"))


def exponent(sources: DataFrame, max_repeats: float, entropy: float | None) -> float:
    """The smallest exponent of the grid that meets the limits; 1 where none does."""
    low, high = -1, 1 << GRID_BITS  # the answer is above low and at most high
    while high - low > 1:
        steps = sorted({low + (high - low) * k // FAN for k in range(1, FAN)} - {low, high})
        tried = sources.withColumn("step", F.explode(F.array(*map(F.lit, steps))))  # fewer than FAN rows a source
        a = F.col("step") / float(1 << GRID_BITS)
        power = F.pow("p", a)
        sums = tried.groupBy("step").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(F.pow("p", a - 1)).alias("most"), F.min(F.pow("p", a - 1)).alias("least"), F.first(a).alias("a"))
        fits = F.col("most") <= max_repeats * F.col("least")
        if entropy is not None:
            fits = fits & (F.log("z") - F.col("a") * F.col("l") / F.col("z") <= entropy)
        good = {r.step for r in sums.where(fits).select("step").collect()}
        high = min((s for s in steps if s in good), default=high)
        low = max((s for s in steps if s < high and s not in good), default=low)
    return high / float(1 << GRID_BITS)


def budgets(sources: DataFrame, a: float) -> DataFrame:
    """``source, rows, n, weight, budget``: each source's weight and the tokens to draw from it, ``n`` at least."""
    power = F.pow("p", F.lit(a))
    sums = sources.agg(F.sum(power).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least"))  # one row
    # repeats of a source are p^(a-1) over the least such value; rounded, so that engines agree on whole tokens
    repeats = F.round(F.pow("p", F.lit(a - 1)) / F.col("least"), 9)
    return sources.crossJoin(F.broadcast(sums)).select("source", "rows", "n", (power / F.col("z")).alias("weight"), F.greatest(F.floor(F.col("n") * repeats + 0.5).cast("long"), "n").alias("budget"))


def bits(*parts: Column) -> Column:
    """A number below 2^32 from the parts' digest."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def plan(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with a row for every draw, and ``__tokens``, ``__weight``, ``__epoch``, ``__block``, ``__turn``, ``__place``.

    Within a source's epoch blocks follow each other by ``__turn``, documents of a block by ``__place``.
    """
    keyed = docs.withColumn("__source", F.to_json(F.struct("source"))).withColumn("__tokens", tokens(F.col("text")))
    sources = shares(keyed.select(F.col("__source").alias("source"), F.col("__tokens").alias("tokens")))
    weighed = checkpointed(budgets(sources, exponent(sources, max_repeats, entropy)))
    whole = F.floor(F.col("budget") / F.col("n"))
    side = weighed.select(F.col("source").alias("__source"), F.col("weight").alias("__weight"), F.ceil(F.col("rows") / BLOCK).alias("__blocks"), whole.alias("__whole"), (F.col("budget") - whole * F.col("n")).alias("__rest"))
    side = F.broadcast(side) if weighed.count() <= BROADCAST_SOURCES else side.hint("merge")
    block = F.pmod(bits(F.lit(seed), F.col("doc_id")), F.col("__blocks"))
    rows = keyed.join(side, "__source").withColumn("__block", F.coalesce(block, F.lit(0)))
    # tokens of the blocks whose turn is before each block's in the last epoch: sums over blocks, not over rows
    sizes = rows.groupBy("__source", "__block", "__whole").agg(F.sum("__tokens").alias("__size")).withColumn("__turn", bits(F.lit(seed), F.lit("turn"), F.col("__block"), F.col("__whole")))
    by_turn = Window.partitionBy("__source").orderBy("__turn", "__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = checkpointed(sizes.select("__source", "__block", F.coalesce(F.sum("__size").over(by_turn), F.lit(0)).alias("__ahead")))
    rows = rows.join(F.broadcast(ahead) if ahead.count() <= BROADCAST_SOURCES else ahead.hint("merge"), ["__source", "__block"])
    # and of the documents before each within its block; a block is about BLOCK rows
    place = bits(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("__whole"))
    in_block = Window.partitionBy("__source", "__block").orderBy(place, "doc_id", F.md5(F.coalesce("text", F.lit("")))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum("__tokens").over(in_block), F.lit(0))
    rows = rows.withColumn("__epochs", F.col("__whole") + (before < F.col("__rest")).cast("long"))
    drawn = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)))
    drawn = drawn.withColumn("__turn", bits(F.lit(seed), F.lit("turn"), F.col("__block"), F.col("__epoch"))).withColumn("__place", bits(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("__epoch")))
    return drawn.select(*docs.columns, "__tokens", "__weight", "__epoch", "__block", "__turn", "__place")


def mixed(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """The drawn rows with the columns of ``docs``, whatever their names; every row once at least."""
    # other columns go under numbers, so that none can be taken for a working column
    own = {c: f"column {k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    plain = docs.select(*(F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns))
    return plan(plain, max_repeats, entropy).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def mixture(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """``doc_id, source, tokens, weight, epoch, block, turn, place`` of every draw."""
    drawn = plan(docs.select("doc_id", "source", "text"), max_repeats, entropy)
    return drawn.select("doc_id", "source", F.col("__tokens").alias("tokens"), F.round("__weight", 6).alias("weight"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__turn").alias("turn"), F.col("__place").alias("place"))


#: the same draws in DuckDB; the exponent is searched over the whole grid at once
ORACLE = f"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens FROM documents),
sources AS (SELECT source, count(*) AS rows, sum(tokens)::BIGINT AS n FROM words GROUP BY source),
shares AS (SELECT *, n / sum(n) OVER () AS p FROM sources),
steps AS (SELECT unnest(range({(1 << GRID_BITS) + 1})) AS step),
spread AS (SELECT max(p) AS hi, min(p) AS lo FROM shares),
picked AS (
  SELECT coalesce(min(step), {1 << GRID_BITS}) / {float(1 << GRID_BITS)} AS a FROM steps, spread
  WHERE step = {1 << GRID_BITS} OR pow(lo, step / {float(1 << GRID_BITS)} - 1) <= {MAX_REPEATS} * pow(hi, step / {float(1 << GRID_BITS)} - 1)),
weights AS (
  SELECT source, rows, n, pow(p, a) / sum(pow(p, a)) OVER () AS weight,
         greatest(floor(n * round(pow(p, a - 1) / min(pow(p, a - 1)) OVER (), 9) + 0.5)::BIGINT, n) AS budget FROM shares, picked),
plan AS (SELECT *, budget // n AS whole, budget % n AS rest, ceil(rows / {BLOCK})::BIGINT AS blocks FROM weights),
placed AS (
  SELECT w.doc_id, w.source, w.text, w.tokens, p.weight, p.whole, p.rest,
         coalesce(('0x' || md5('0:' || w.doc_id)[1:8])::BIGINT % p.blocks, 0) AS block
  FROM words w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source),
sizes AS (SELECT source, block, whole, sum(tokens) AS size FROM placed GROUP BY ALL),
ahead AS (
  SELECT source, block, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || md5('0:turn:' || block || ':' || whole)[1:8])::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sizes),
timed AS (
  SELECT p.*, a.ahead + coalesce(sum(tokens) OVER (PARTITION BY p.source, p.block ORDER BY ('0x' || md5('0:place:' || doc_id || ':' || whole)[1:8])::BIGINT, doc_id, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed p JOIN ahead a ON p.source IS NOT DISTINCT FROM a.source AND p.block = a.block),
drawn AS (SELECT *, unnest(range(whole + (before < rest)::BIGINT)) AS epoch FROM timed)
SELECT doc_id, source, tokens, round(weight, 6) AS weight, epoch, block,
       ('0x' || md5('0:turn:' || block || ':' || epoch)[1:8])::BIGINT AS turn, ('0x' || md5('0:place:' || doc_id || ':' || epoch)[1:8])::BIGINT AS place
FROM drawn
"""
