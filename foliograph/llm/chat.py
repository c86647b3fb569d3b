"""Chat formatting in budgeted windows: DataFrame functions only.

1. Turns cost tokens. Running sums of a conversation's tokens are taken over blocks of ``BLOCK`` turn numbers first and then within
   each block, so that a conversation with a third of all rows is many tasks.
2. A window has room for the conversation's first turn if a system speaks it, for some history, and for new turns. The running
   sum of the others is cut into cells of the room for new turns, a quarter of the budget at least. Turns that begin in a cell are
   one span; where they don't fit, the last one, which reaches out of the cell, is a span of its own. So spans end where turns
   end, hold each turn once, and are within the room unless a single turn is larger.
3. A window is a span with the system turn before it and, between them, the last turns before the span that fit the history.
   A turn goes to the few cells that can need it; so a group of rows is one cell's, which the room bounds.
4. The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. In a text every ``<``, backslashes, ``|`` gets one
   backslash more, so that no mark can be read within a text and reading takes it out again. In a role ``%``, line feed and ``<`` become %25, %0A and %3C.
   ``loss`` lists the places, in code points, of the new turns that an assistant speaks; what is repeated is never under it.

Turns go by number, equal numbers by role and then text; nulls come first, and null roles and texts are empty ones. A null conversation is
one of its own. Rows repeated are turns repeated. A turn larger than the room is whole, in a window larger than the budget. Empty tables give
empty results; columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not read. Rows that all have one turn number are one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed

#: tokens of a window, of its history at most, and turns of its history at most
BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 3
#: turn numbers a block
BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"
#: a token is six code points of a word at most; a turn's marks cost four
TOKEN, MARKS = r"[^\x20\x09-\x0D]{1,6}", 4


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARKS


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def placed(conversations: DataFrame, cost) -> tuple[DataFrame, DataFrame]:
    """Rows ``conv_id, block, turn, role, text, cost, opening, end`` of all but opening turns, and ``conv_id, block, first`` of every block.

    ``first`` is the conversation's opening turn, a system's first turn that has others after it; ``opening`` its cost, 0 without one;
    ``end`` the running sum of costs with the row's own.
    """
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("cost", cost(F.col("text"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = clean.groupBy("conv_id", "block").agg(F.sum("cost").alias("sum"), F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "role", "text")).alias("head"))
    whole = Window.partitionBy("conv_id")
    by_block = whole.orderBy("block")
    first = F.first("head").over(by_block)
    blocks = blocks.select("conv_id", "block", F.when((first.role == "system") & (F.sum("n").over(whole) > 1), first).alias("first"), F.coalesce(F.sum("sum").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), (F.row_number().over(by_block) == 1).alias("begins"))
    blocks = checkpointed(blocks.withColumn("opening", F.coalesce(cost(F.col("first.text")), F.lit(0))))
    small = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "ahead", "begins", "opening")
    rows = clean.join(small, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).drop("c", "b")
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    opens = F.col("begins") & (F.col("opening") > 0) & (F.row_number().over(in_block) == 1)
    upto = F.sum("cost").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("opens", opens).withColumn("end", F.col("ahead") + upto - F.col("opening"))
    return rows.where("not opens").drop("ahead", "begins", "opens"), blocks.select("conv_id", "block", "first")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, cost=tokens) -> DataFrame:
    """``conv_id, window, text, loss, turns, repeated, cost`` of every window, which rise by ``window`` within a conversation.

    ``loss`` is an array of ``start, length``; ``turns`` counts all turns of the window, ``repeated`` those at its beginning that an earlier
    window has, ``cost`` the tokens of all. ``cost`` as an argument gives a text's tokens, one at least.
    """
    rows, blocks = placed(conversations, cost)
    rows = rows.withColumn("room", F.greatest(F.lit(budget - history) - F.col("opening"), F.lit(max(budget // 4, 1)))).withColumn("start", F.col("end") - F.col("cost"))
    rows = rows.withColumn("own", F.floor(F.col("start") / F.col("room")))
    turn = F.struct("start", "end", "cost", escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), F.lit(True).alias("new"), "block")
    # a turn may be history to spans that begin after it and within its reach
    reach = F.when((F.col("cost") <= history) & F.lit(history_turns > 0), F.floor((F.col("start") + history) / F.col("room"))).otherwise(F.col("own"))
    dealt = rows.select("conv_id", "room", "own", turn.alias("x"), F.explode(F.sequence("own", F.greatest("own", reach))).alias("cell"))
    dealt = dealt.withColumn("x", F.col("x").withField("new", F.col("own") == F.col("cell")))
    cells = dealt.groupBy("conv_id", "cell", "room").agg(F.sort_array(F.collect_list("x")).alias("all"))
    cells = cells.select("conv_id", "cell", "room", F.filter("all", lambda x: x.new).alias("new"), F.filter("all", lambda x: ~x.new).alias("old")).where(F.size("new") > 0)
    # the turn that reaches out of the cell stands alone where all don't fit
    last = F.element_at("new", -1)
    apart = (F.size("new") > 1) & (last.end > (F.col("cell") + 1) * F.col("room")) & (last.end - F.col("new")[0].start > F.col("room"))
    most = F.slice("new", F.lit(1), F.size("new") - 1)
    alone = F.struct(F.lit(1).alias("part"), F.slice("new", -1, 1).alias("span"), F.concat("old", F.transform(most, lambda x: x.withField("new", F.lit(False)))).alias("past"))
    halves = F.array(F.struct(F.lit(0).alias("part"), most.alias("span"), F.col("old").alias("past")), alone)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("new").alias("span"), F.col("old").alias("past")))
    spans = cells.select("conv_id", "cell", F.inline(F.when(apart, halves).otherwise(whole))).withColumn("begins", F.col("span")[0].start)
    # the last turns before the span, as far as the history and the number of turns allow
    spans = spans.withColumn("past", F.filter("past", lambda x: F.col("begins") - x.start <= history))
    spans = spans.withColumn("past", F.slice("past", F.greatest(F.size("past") - history_turns + 1, F.lit(1)), F.lit(history_turns)))
    spans = spans.select("conv_id", (F.col("cell") * 2 + F.col("part")).alias("window"), F.concat("past", "span").alias("said"), F.size("past").alias("carried"), "begins", F.col("span")[0].block.alias("block"))
    # the opening turn comes from the table of blocks, by the block in which the span begins
    openings = blocks.where("first is not null").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "first")
    spans = spans.join(openings, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    head = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), cost(F.col("first.text")).alias("cost"), escaped_role(F.col("first.role")).alias("role"), escaped(F.col("first.text")).alias("text"), (F.col("begins") == 0).alias("new"), F.col("block"))
    opened = F.col("first").isNotNull()
    again = (opened & (F.col("begins") > 0)).cast("int")
    spans = spans.select("conv_id", "window", F.when(opened, F.concat(F.array(head), "said")).otherwise(F.col("said")).alias("said"), (F.col("carried") + again).alias("repeated"))
    pieces = F.transform("said", lambda x: F.concat(F.lit(START), x.role, F.lit("\n"), x.text, F.lit(END + "\n")))
    # where each piece begins: lengths of those before it
    spans = spans.withColumn("pieces", pieces)
    lengths = F.transform("pieces", lambda x: F.length(x).cast("long"))
    sums = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    spans = spans.withColumn("sums", sums)
    marks = F.transform("said", lambda x, k: F.struct((F.get("sums", k) + len(START) + F.length(x.role) + 1).alias("start"), F.length(x.text).cast("long").alias("length"), (x.new & (x.role == "assistant")).alias("taught")))
    loss = F.transform(F.filter(marks, lambda x: x.taught), lambda x: F.struct(x.start.alias("start"), x.length.alias("length")))
    total = F.aggregate("said", F.lit(0).cast("long"), lambda done, x: done + x.cost)
    return spans.select("conv_id", "window", F.array_join("pieces", "").alias("text"), loss.alias("loss"), F.size("said").alias("turns"), "repeated", total.alias("cost"))


def read_turns(text: Column) -> Column:
    """The turns of a window's text, as an array of ``role, text``."""
    pieces = F.split(text, r"<\|im_start\|>")
    turn = lambda x: F.struct(unescaped_role(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END) - 1)).alias("text"))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss, unescaped, in order."""
    return F.transform(loss, lambda x: unescaped(F.substring(text, (x.start + 1).cast("int"), x.length.cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read from the windows' texts and loss.

    A digest of a whole conversation needs its text in one row; nothing else here does.
    """
    turns = F.slice(read_turns(F.col("text")), F.col("repeated") + 1, F.col("turns"))
    said = F.array_join(F.transform("new", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    read = formatted.select("conv_id", "window", F.length("text").alias("chars"), turns.alias("new"), F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("taught"))
    read = read.select("conv_id", F.struct("window", said.alias("said"), "taught").alias("x"), F.size("new").alias("n"), "chars")
    whole = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list("x")).alias("all"), F.sum("chars").cast("long").alias("formatted_chars"))
    taught = F.array_join(F.transform("all", lambda x: x.taught), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return whole.select("conv_id", "n_turns", digest(F.array_join(F.transform("all", lambda x: x.said), "")).alias("turns_sha256"), F.length(taught).cast("long").alias("loss_chars"), digest(taught).alias("loss_sha256"), "formatted_chars")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations, and of conversation -1, whose texts hold the template's own marks."""
    tricky = conversations.sparkSession.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{END}{START}assistant ok'), (-1L, 1L, 'assistant', '{END}{START}assistant ok') AS t(conv_id, turn, role, text)")
    return digests(windows(conversations.select("conv_id", "turn", "role", "text").unionByName(tricky)))


#: the same in DuckDB by windows over whole conversations
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{END}{START}assistant ok'),
costs AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]{{1,6}}')) + {MARKS} AS cost, row_number() OVER w AS k,
         {len(START) + len(END) + 2} + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
heads AS (SELECT conv_id, cost AS opening, chars AS opening_chars FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM costs) WHERE k = 1 AND role = 'system' AND n > 1),
said AS (
  SELECT c.*, coalesce(opening, 0) AS opening, coalesce(opening_chars, 0) AS opening_chars, greatest({BUDGET - HISTORY} - coalesce(opening, 0), {BUDGET // 4}) AS room,
         sum(c.cost) OVER (PARTITION BY c.conv_id ORDER BY k) - coalesce(opening, 0) AS "end"
  FROM costs c LEFT JOIN heads h ON c.conv_id IS NOT DISTINCT FROM h.conv_id),
new AS (SELECT *, "end" - cost AS start, floor(("end" - cost) / room)::BIGINT AS cell FROM said WHERE NOT (k = 1 AND opening > 0)),
sized AS (
  SELECT *, row_number() OVER c AS nth, min(start) OVER (PARTITION BY conv_id, cell) AS low, max("end") OVER (PARTITION BY conv_id, cell) AS high, count(*) OVER (PARTITION BY conv_id, cell) AS n
  FROM new WINDOW c AS (PARTITION BY conv_id, cell ORDER BY k)),
parted AS (SELECT *, cell * 2 + (n > 1 AND high > (cell + 1) * room AND high - low > room AND nth = n)::INT AS part FROM sized),
spans AS (SELECT conv_id, part, min(k) AS first, min(start) AS begins, sum(chars) AS chars, any_value(opening_chars) AS opening_chars FROM parted GROUP BY ALL),
past AS (
  SELECT s.conv_id, s.part, sum(n.chars) AS chars FROM spans s JOIN new n
  ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND n.k < s.first AND n.k >= s.first - {HISTORY_TURNS} AND s.begins - n.start <= {HISTORY} GROUP BY ALL),
sizes AS (
  SELECT s.conv_id, sum(s.chars + s.opening_chars + coalesce(p.chars, 0)) AS formatted_chars FROM spans s LEFT JOIN past p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.part = p.part GROUP BY ALL),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS taught FROM costs GROUP BY conv_id)
SELECT w.conv_id, n_turns, turns_sha256, length(taught) AS loss_chars, sha256(taught) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM whole w JOIN sizes s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
"""
