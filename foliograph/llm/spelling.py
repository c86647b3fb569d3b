"""Spelling variants by anagram hashing.

1. Words are runs of letters, lower-cased by A-Z only and counted over all texts; counts combine before the shuffle.
2. A word's key is the sum of its letters' fifth powers: anagrams share it, and taking a letter out takes that letter's power
   away. Words that differ by an added or removed letter have ``key - power = key'``; words that differ by an exchange have
   ``key - power = key' - power'``. So each word is dealt under its key less each of its letters, and under its key.
3. What meets under a key is checked for the order of its letters: the rest of the word without the letter is read as two
   polynomials of its letters modulo primes near 2^31, worked out for every place from running sums, and is part of what the
   rows are grouped by, as is the place of an exchanged letter. A false match needs the 64-bit key and both polynomials to agree.
   Words that agree in all but the letter at one place are as many as there are letters, 90 at most; those that become one word by
   losing a letter are 90 for each of its places at most. So no group is large, and none is multiplied out to pairs: each
   member takes the group's count and its first, or its second if it is the first itself.
4. A word's form is its near word with the largest count. Forms are followed from the roots down, one join a level; counts
   rise by ``TIMES`` a level, so levels are few.

Words get numbers in code-point order, which stand for them in all joins; a word of a million letters is a million small rows.

Null texts have no word; a null id counts as an empty string in the typing rule; equal rows count as often as they are there;
empty tables give empty results; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed, lean

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: code points of a word and occurrences at least; how many times a form's count is a word's at least
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: one run in so many loses a letter
SLIPS = 199
#: letters that a worker takes apart at a time
LETTERS_AT_ONCE = 1 << 20
#: primes, and the base of each polynomial with its inverse
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525))


def words_of(docs: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``doc_id, word`` of every run of letters of ``least_letters`` or more, lower-cased by A-Z only."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_letters)
    return runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def slipped(doc_id: Column, word: Column) -> Column:
    """``word``, without one letter if the crc32 of ``<doc_id>:<word>`` is divisible by ``SLIPS``."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(hashed, F.length(word)).cast("int")
    return F.when(hashed % SLIPS == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


@lru_cache(4)
def powers(prime: int, base: int, size: int) -> np.ndarray:
    """``base ** k`` modulo ``prime`` for ``k`` below ``size``, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < size:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


def taken_apart(numbers: np.ndarray, counts: np.ndarray, words: list[str]) -> dict[str, np.ndarray]:
    """Rows under which words meet: ``r`` the key (less a letter), ``h`` the order of the letters left, ``p`` the place of an exchanged letter or -1
    where a letter more or less is sought, ``short`` whether the row is the whole word."""
    sizes = np.array([*map(len, words)], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - starts[of]
    with np.errstate(over="ignore"):
        value = letters**5
        key = np.add.reduceat(value, starts)
    whole, rest = np.zeros(len(words), np.int64), np.zeros(len(letters), np.int64)
    size = 1 << int(sizes.max()).bit_length()
    for prime, base in PRIMES:
        term = letters * powers(prime, base, size)[place] % prime
        upto = np.concatenate([[0], np.cumsum(term)])
        before = (upto[:-1] - upto[starts][of]) % prime
        after = (upto[ends][of] - upto[1:]) % prime
        whole = whole << 31 | (upto[ends] - upto[starts]) % prime
        rest = rest << 31 | (before + after * pow(base, -1, prime)) % prime
    first = np.ones(len(letters), bool)  # of equal letters side by side: without any of them the same is left
    first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    with np.errstate(over="ignore"):
        less = key[of] - value
    parts = [(key, whole, np.full(len(words), -1), numbers, counts, np.ones(len(words), bool)), (less[first], rest[first], np.full(int(first.sum()), -1), numbers[of[first]], counts[of[first]], np.zeros(int(first.sum()), bool)), (less, rest, place, numbers[of], counts[of], np.zeros(len(letters), bool))]
    r, h, p, i, n, short = map(np.concatenate, zip(*parts, strict=True))
    return {"r": r, "h": h, "p": p, "id": i, "n": n, "short": short}


def dealt(vocabulary: DataFrame) -> DataFrame:
    """Every row under which a word of ``id, word, n`` can meet near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            numbers, counts = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            sizes = np.cumsum([0, *map(len, words)])
            low = 0
            while low < len(words):
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + LETTERS_AT_ONCE, "right")) - 1)
                yield pa.RecordBatch.from_pydict(taken_apart(numbers[low:high], counts[low:high], words[low:high]))
                low = high

    return vocabulary.select("id", "word", "n").mapInArrow(lean(run), "r long, h long, p long, id long, n long, short boolean")


def near(vocabulary: DataFrame) -> DataFrame:
    """``id, n_near, best`` of every word with a near word; ``best`` is ``n, id`` of the one of largest count, the first of equal ones."""
    met = dealt(vocabulary).groupBy("r", "h", "p").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("minus"), "short")).alias("all")).where(F.size("all") > 1)
    ranked = lambda rows: F.transform(rows, lambda x: F.struct(x.n.alias("n"), x.minus.alias("minus")))
    longer, whole = F.filter("all", lambda x: ~x.short), F.filter("all", lambda x: x.short)
    # exchanges: the first of all, and the first of the others for itself
    top = F.array_max(ranked(F.col("all")))
    second = F.array_max(ranked(F.filter("all", lambda x: x.minus != F.col("top.minus"))))
    exchanged = met.where("p >= 0").withColumn("top", top).withColumn("second", second)
    exchanged = exchanged.select(F.explode("all").alias("x"), (F.size("all") - 1).alias("near"), "top", "second")
    exchanged = exchanged.select(F.col("x.minus").alias("minus"), "near", F.when(F.col("x.minus") == F.col("top.minus"), F.col("second")).otherwise(F.col("top")).alias("best"))
    # a letter more or less: the whole word meets those that become it
    added = met.where("p < 0").withColumn("whole", F.get(whole, F.lit(0))).where("whole is not null").withColumn("longer", longer)
    short = F.struct(F.col("whole.minus").alias("minus"), F.size("longer").alias("near"), F.array_max(ranked(F.col("longer"))).alias("best"))
    each = F.transform("longer", lambda x: F.struct(x.minus.alias("minus"), F.lit(1).alias("near"), F.struct(F.col("whole.n").alias("n"), F.col("whole.minus").alias("minus")).alias("best")))
    added = added.select(F.inline(F.concat(F.array(short), each)))
    return exchanged.unionByName(added).groupBy((-F.col("minus")).alias("id")).agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame, named: DataFrame) -> DataFrame:
    """``id, root`` of every id of ``id, form``: the name (by ``id, root``) of where its forms lead. From the roots down: no join meets all that share a root."""
    level = links.select(F.col("form").alias("id")).distinct().join(links.select("id"), "id", "left_anti").join(named, "id")
    found = None
    while True:
        above = level.select(F.col("id").alias("form"), "root")
        level = checkpointed(links.join(above, "form").select("id", "root"))
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)


def grouped(words: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every distinct value of ``word`` that is there ``least_count`` times or more."""
    counted = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))
    vocabulary = checkpointed(counted.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    chosen = near(vocabulary).select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best_id"))
    right = F.col("best_n") >= times * F.col("n")
    chosen = checkpointed(vocabulary.join(chosen, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(right, F.col("best_id")).alias("form_id"), F.when(right, F.col("best_n")).alias("form_n")))
    linked = chosen.where("form_id is not null")
    ends = roots(linked.select("id", F.col("form_id").alias("form")), vocabulary.select("id", F.col("word").alias("root")))
    forms = linked.select("id", "form_id").join(vocabulary.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id").drop("form_id")
    out = chosen.join(forms, "id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of all texts, after the slips of the pen that the query asks for."""
    spelled = words_of(docs).select(slipped(F.col("doc_id"), F.col("word")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return grouped(spelled)


#: the same in DuckDB: crc32 byte by byte, near words by what is left without one letter
ORACLE = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS word FROM documents)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY ALL),
crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps
  FROM (SELECT unnest(range(256)) AS b)),
hashed AS MATERIALIZED (
  SELECT r.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda k: ('0x' || digits[2 * k + 1 : 2 * k + 2])::BIGINT)),
         lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)) AS digits FROM runs) r, crc),
slipped AS (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN word[1 : h % length(word)] || word[h % length(word) + 2 :] ELSE word END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary),
rests AS MATERIALIZED (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS rest FROM places),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM rests a JOIN rests b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM rests a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM rests a JOIN vocabulary v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM pairs GROUP BY word),
chosen AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * v.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
led AS (
  SELECT word, word AS root FROM chosen WHERE form IS NULL
  UNION ALL SELECT c.word, l.root FROM led l JOIN chosen c ON c.form = l.word)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN led USING (word)
"""
