"""MinHash near-duplicates: many universal hash minima with banding, signature verification, connected components.

1. A text's set of word shingles is hashed; texts with the same set form one class, and only the class's smallest id
   goes on, so copies never meet each other.
2. ``BANDS * ROWS`` universal hashes of the set give minima. Classes that agree in all minima of a band are in one
   bucket. Each bucket names two members as centres, one at random by band, one by its company over all bands; every
   member is a candidate with both. So a bucket of n members gives 2 n pairs at most, however large the group.
3. Signatures rule out candidates (the share of equal minima is far below the threshold). The rest is confirmed on the
   full sets in integers: first each class's most similar centre, which ties most groups together, then the
   candidates that still lie in different components. A centre's set is sent once to each partition that streams some
   of its members, not once a pair.
4. Buckets that then still hold several components give the pairs across them. All members of such buckets with one
   heart are a crowd. The pairs of a small crowd (``SMALL`` members) are judged and confirmed like the others. In a
   larger one a member is its difference from the heart (the shingles that only one of the two has): with a and b
   elements and c in common, two members' sets differ in a + b - 2 c, so the differences alone decide exactly. They
   are dealt into blocks, the members outside the crowd's largest component against all, and each pair of blocks gives
   only the links that join components. No bucket, candidate or partner is capped; the work within one crowd grows with
   its members times those outside its largest component.

Components are those of alternating large-star and small-star. A pair at the threshold of 0.8 is missed with
probability (1 - 0.8^5)^32 = 3e-6 for want of a common bucket, and 2e-9 because its signature, 160 bytes, agrees in
less than ``RULED_OUT`` of them; more similar pairs are missed more rarely.

Null texts and texts without a word have the empty set and are linked with nothing. Repeated rows of one id are one
document each with that id; of different texts under one id each is linked by its own set. A null id is never linked:
its row keeps a null component and is kept. An empty table gives no row. Ties between centres go by hash and then id.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.graph import components
from foliograph.llm.shared import BROADCAST_IDS, ROWS_AT_ONCE, checkpointed, each_text, lean, only_ids, pieces
from foliograph.llm.textvec import MULTIPLIERS, U, followed, lay, mix, word_hashes

BANDS = 32
ROWS = 5
#: an estimate of the similarity below this rules a pair out: nearly five standard deviations under the threshold
RULED_OUT = 0.6
#: members of a centre that a partition streams past one copy of its set
STREAMED = 256
#: partitions that one row of a centre's text is read for
COPIES = 64
#: members up to which a crowd's pairs are listed
SMALL = 8
#: members of a larger crowd in a block, about
BLOCK = 256
#: elements that blocks are compared by at a time
ELEMENTS = 1 << 13
SIGNED = "doc_id long, n_shingles long, set_key binary, signature array<long>, bands array<long>"


@lru_cache(1)
def universal() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts of the universal hashes x -> (m x + s) / 2^32."""
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, and how many each text has.

    A text with fewer words than ``width`` has its whole sequence as the only shingle.
    """
    p = lay(texts, lower=True)
    h = word_hashes(p)
    run, at = followed(h, p.word_doc, width)
    n_words = np.bincount(p.word_doc, minlength=p.n)
    owner = p.word_doc[at]
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    first = np.searchsorted(p.word_doc, few)
    short = np.zeros(len(few), U)
    for k in range(width - 1):
        inside = n_words[few] > k
        short[inside] = mix(short[inside] * U(MULTIPLIERS[5]) + h[first[inside] + k])
    run, owner = np.concatenate([run, short]), np.concatenate([owner, few])
    order = np.argsort(run)
    order = order[np.argsort(owner[order], kind="stable")]
    run, owner = run[order], owner[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])]) if len(run) else np.zeros(0, bool)
    return run[new], np.bincount(owner[new], minlength=p.n)


def minima(run: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each set's minimum under every universal hash, as 32-bit integers; sets must not be empty."""
    first = np.cumsum(size) - size
    m, s = universal()
    out = np.empty((len(size), len(m)), np.uint32)
    for k in range(len(m)):
        out[:, k] = np.minimum.reduceat(((run * m[k] + s[k]) >> U(32)).astype(np.uint32), first)
    return out


def sign(texts: list[bytes], width: int) -> dict[str, list]:
    run, size = shingle_sets(texts, width)
    some = np.flatnonzero(size)
    end = np.cumsum(size)
    keys: list[bytes | None] = [None] * len(texts)
    signature: list[list[int] | None] = [None] * len(texts)
    bands: list[list[int] | None] = [None] * len(texts)
    if len(some):
        least = minima(run, size[some])
        code = np.zeros((len(some), BANDS), U)
        grid = least.reshape(len(some), BANDS, ROWS).astype(U)
        for k in range(ROWS):
            code = mix(code * U(MULTIPLIERS[6]) + grid[:, :, k])
        short = (least & 0xFF).astype(np.uint8)
        for j, i in enumerate(some.tolist()):
            keys[i] = hashlib.blake2b(run[end[i] - size[i] : end[i]].tobytes(), digest_size=16).digest()
            signature[i] = short[j].view(np.int64)
            bands[i] = code[j].view(np.int64)
    return {"n_shingles": size, "set_key": keys, "signature": signature, "bands": bands}


def signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            done: dict[str, list] = {"n_shingles": [], "set_key": [], "signature": [], "bands": []}
            for piece in pieces(each_text(batch)):
                for k, v in sign(piece, width).items():
                    done[k].extend(v)
            kinds = {"n_shingles": pa.int64(), "set_key": pa.binary(), "signature": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in done.items()})

    return docs.select("doc_id", "text").mapInArrow(lean(run), SIGNED)


def agreement(a: Column, b: Column) -> Column:
    """How many of the signatures' bytes are equal; a signature is packed into longs."""

    def differing(word: int) -> Column:
        z = F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word)))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(z)

    words = BANDS * ROWS // 8
    return F.lit(BANDS * ROWS) - sum((differing(k) for k in range(1, words)), differing(0))


def possible(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be as similar as asked at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def judged(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``centre, member, equal`` of the pairs that their sizes and signatures don't rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("centre"), "centre").join(side("member"), "member").where(possible(F.col("ncentre"), F.col("nmember"), percent))
    return both.select("centre", "member", agreement(F.col("scentre"), F.col("smember")).alias("equal")).where(F.col("equal") >= int(RULED_OUT * BANDS * ROWS))


SENT = "centre long, part int, node long, shingles binary"


def gathered(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full sets of the ``member``s of each ``centre``, behind the centre's own, dealt by centre and part of its members.

    A part has about ``STREAMED`` members. Only the texts named in the pairs are read.
    """
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STREAMED).cast("int").alias("parts"))
    members = pairs.join(sizes, "centre").select(F.col("member").alias("doc_id"), "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("low"), F.lit(1).alias("parts"))
    low = F.explode(F.sequence(F.lit(0), F.col("parts") - 1, F.lit(COPIES)))
    centres = sizes.select(F.col("centre").alias("doc_id"), "centre", low.alias("low"), "parts").withColumn("parts", F.least(F.lit(COPIES), F.col("parts") - F.col("low")))
    wanted = checkpointed(members.union(centres))
    texts = only_ids(docs.select("doc_id", "text"), wanted, wanted.count(), "inner")

    def run(batches):
        for batch in batches:
            ids, centres, lows, parts = (batch.column(c).to_pylist() for c in ("doc_id", "centre", "low", "parts"))
            row = 0
            for piece in pieces(each_text(batch)):
                hashes, size = shingle_sets(piece, width)
                out: dict[str, list] = {"centre": [], "part": [], "node": [], "shingles": []}
                for shingles in np.split(hashes, np.cumsum(size)[:-1]):
                    raw = shingles.tobytes()
                    for k in range(parts[row]):
                        for name, value in zip(out, (centres[row], lows[row] + k, ids[row], raw), strict=True):
                            out[name].append(value)
                    row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    sets = texts.select("doc_id", "text", "centre", "low", "parts").mapInArrow(lean(run), SENT)
    first = F.col("node") != F.col("centre")
    return sets.repartition("centre", "part").sortWithinPartitions("centre", "part", first, "node")


def beside_centre(sets: DataFrame, schema: str, judge) -> DataFrame:
    """What ``judge(centre, centre's set, node, node's set)`` gives for each node of ``gathered`` sets; None gives no row."""

    def run(batches):
        at, own = None, np.zeros(0, U)
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                for centre, k, node, raw in zip(*(part.column(c).to_pylist() for c in ("centre", "part", "node", "shingles")), strict=True):
                    if node == centre:
                        at, own = (centre, k), np.frombuffer(raw, U)
                    elif at == (centre, k) and (row := judge(centre, own, node, np.frombuffer(raw, U))) is not None:
                        rows.append(row)
            kinds = arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)], schema=kinds)

    return sets.select("centre", "part", "node", "shingles").mapInArrow(lean(run), schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if not len(x) or not len(y):
        return 0
    few, many = (x, y) if len(x) < len(y) else (y, x)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs ``centre, member`` whose full sets are as similar as asked."""

    def judge(centre, x, node, y):
        common = shared_count(x, y)
        return (min(centre, node), max(centre, node)) if 100 * common >= percent * (len(x) + len(y) - common) and common else None

    return beside_centre(gathered(pairs.select("centre", "member"), docs, width), "a long, b long", judge).distinct()


def differences(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``heart, node, n, difference``: each member's set as what only it or its heart has, hashes in order, and its size."""

    def judge(centre, x, node, y):
        both = np.sort(np.concatenate([x, y]))
        twice = np.flatnonzero(both[1:] == both[:-1])
        alone = np.ones(len(both), bool)
        alone[twice] = alone[twice + 1] = False
        return centre, node, len(y), both[alone].tobytes()

    return beside_centre(gathered(pairs, docs, width), "heart long, node long, n long, difference binary", judge)


class Forest:
    """Which of the components met are one by now."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def joins(self, x: int, y: int) -> bool:
        """Whether x and y were apart until now."""
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def holders(sets: list[np.ndarray], elements: np.ndarray) -> np.ndarray:
    """A row a set, a column for each of the sorted elements: 1 where the set has it."""
    out = np.zeros((len(sets), len(elements)), np.float32)
    for k, x in enumerate(sets):
        at = np.minimum(np.searchsorted(elements, x), len(elements) - 1)
        out[k, at[elements[at] == x]] = 1
    return out


def block_links(left: list[tuple], right: list[tuple], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links (node, node) that join components between two blocks of ``node, part, n, difference``; ``same``: within one."""
    x, y = [r[3] for r in left], [r[3] for r in right]
    elements = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)))
    common = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(elements), ELEMENTS):
        part = elements[lo : lo + ELEMENTS]
        common += holders(x, part) @ holders(y, part).T
    apart = np.array([len(d) for d in x])[:, None] + np.array([len(d) for d in y])[None, :] - 2 * common.astype(np.int64)
    sizes = np.array([r[2] for r in left])[:, None] + np.array([r[2] for r in right])[None, :]
    # the intersection is (sizes - apart) / 2, the union (sizes + apart) / 2
    linked = (100 * (sizes - apart) >= percent * (sizes + apart)) & (sizes > apart)
    linked &= np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])[None, :]
    if same:
        linked &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
    forest = Forest()
    return [(left[i][0], right[j][0]) for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True) if forest.joins(left[i][1], right[j][1])]


def crowd_links(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links across the components of each crowd; ``members (heart, node, part, minor, n, difference)``.

    The members outside the largest component (``minor``) fill blocks of their own and are compared with each other and
    with the blocks of the rest.
    """
    sizes = members.groupBy("heart").agg(*(F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for c, n in ((F.col("minor"), "minors"), (~F.col("minor"), "others"))))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("others"))).cast("int")
    placed = members.join(sent(checkpointed(sizes)), "heart").withColumn("own", F.when(F.col("minor"), block).otherwise(F.col("minors") + block))
    every = F.sequence(F.lit(0), F.col("minors") + F.col("others") - 1)
    partners = F.when(F.col("minor"), every).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    dealt = placed.where("minors > 0").withColumn("other", F.explode(partners)).select("heart", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "part", "n", "difference")
    ordered = dealt.repartition("heart", "left", "right").sortWithinPartitions("heart", "left", "right", "side", "node")
    schema = "a long, b long"

    def run(batches):
        at, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            found = []
            if at is not None:
                same = at[1] == at[2]
                if sides[0] and (same or sides[1]):
                    found = block_links(sides[0], sides[0] if same else sides[1], same, percent)
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], schema=arrow_schema(schema))

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                for heart, left, right, side, node, of, n, raw in zip(*(part.column(c).to_pylist() for c in part.schema.names), strict=True):
                    if at != (heart, left, right):
                        yield done()
                        at, sides = (heart, left, right), ([], [])
                    sides[side].append((node, of, n, np.frombuffer(raw, U)))
        yield done()

    return ordered.mapInArrow(lean(run), schema).distinct()


def sent(facts: DataFrame) -> DataFrame:
    """A checkpointed table of facts about crowds, broadcast while it is small: the members of a large crowd then stay where they are."""
    return F.broadcast(facts) if facts.count() <= BROADCAST_IDS else facts.hint("merge")


def labelled(nodes: DataFrame, parts: DataFrame, name: str, to: str) -> DataFrame:
    """``nodes`` with the component of column ``name`` in ``to``; a node without a link is its own."""
    return nodes.join(parts.select(F.col("node").alias(name), F.col("component").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))


def candidates_by_centre(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with more than one and the bucket's heart, and the pairs ``centre, member`` of the buckets' two centres.

    One centre is random by band. The other, the heart, is the member in the most company over all its buckets: the text
    that the rest of a group derives from, where it is there.
    """
    order = F.struct(F.xxhash64("node", "band").alias("h"), "node")
    buckets = members.groupBy("band", "code").agg(F.min(order)["node"].alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = checkpointed(members.join(buckets, ["band", "code"]))
    company = crowded.groupBy("node").agg(F.sum("n").alias("company"))
    hearts = crowded.join(company, "node").groupBy("band", "code").agg(F.max(F.struct("company", F.xxhash64("node").alias("h"), "node"))["node"].alias("heart"))
    crowded = checkpointed(crowded.drop("n").join(hearts, ["band", "code"]))
    ends = crowded.select("node", F.explode(F.array("centre", "heart")).alias("centre")).where("node <> centre")
    # of two that are each other's centre the smaller id stays one
    once = ends.groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.min("centre").alias("centre"))
    pairs = once.select("centre", F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")).alias("member"))
    return crowded.drop("centre"), checkpointed(pairs)


def class_components(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, component`` of the classes ``nodes (node, n, signature, bands)`` that have a link."""
    crowded, pairs = candidates_by_centre(nodes.select("node", F.posexplode("bands").alias("band", "code")))
    candidates = checkpointed(judged(pairs, nodes, percent))
    # the most similar partner of each class first: about one pair a class ties most groups together
    ends = candidates.select(F.explode(F.array("centre", "member")).alias("node"), F.struct("equal", (-F.col("centre")).alias("c"), (-F.col("member")).alias("m"), "centre", "member").alias("p"))
    best = checkpointed(ends.groupBy("node").agg(F.max("p").alias("p")).select("p.centre", "p.member").distinct())
    links = checkpointed(confirmed(best, docs, width, percent))
    parts = sent(checkpointed(components(links)))
    apart = labelled(labelled(candidates.select("centre", "member"), parts, "centre", "ca"), parts, "member", "cb").where("ca <> cb").select("centre", "member")
    rest = checkpointed(apart.join(best, ["centre", "member"], "left_anti"))
    if not rest.isEmpty():
        links = checkpointed(links.union(confirmed(rest, docs, width, percent)))
        parts = sent(checkpointed(components(links)))
    # crowds that still hold several components: the members of torn buckets, by the bucket's heart
    split = checkpointed(labelled(crowded, parts, "node", "part"))
    torn = split.groupBy("band", "code").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band", "code")
    crowds = checkpointed(split.join(torn, ["band", "code"]).where("node <> heart").select("heart", "node", "part").distinct())
    sizes = crowds.groupBy("heart", "part").agg(F.count(F.lit(1)).alias("n"))
    main = checkpointed(sizes.groupBy("heart").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("crowd"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    crowds = checkpointed(crowds.join(sent(main), "heart").select("heart", "node", "part", (F.col("part") != F.col("main")).alias("minor"), "crowd"))
    if crowds.isEmpty():
        return parts
    few = crowds.where(F.col("crowd") <= SMALL).select("heart", "node", "part")
    listed = few.alias("x").join(few.select("heart", F.col("node").alias("member"), F.col("part").alias("other")).alias("y"), "heart").where("node < member and part <> other")
    late = checkpointed(judged(listed.select(F.col("node").alias("centre"), "member").distinct().join(pairs, ["centre", "member"], "left_anti"), nodes, percent))
    found = [confirmed(late, docs, width, percent)] if not late.isEmpty() else []
    many = crowds.where(F.col("crowd") > SMALL)
    if not many.isEmpty():
        drawn = differences(many.select(F.col("heart").alias("centre"), F.col("node").alias("member")), docs, width)
        found.append(crowd_links(checkpointed(drawn.join(many.select("heart", "node", "part", "minor"), ["heart", "node"])), percent))
    if found:
        more = checkpointed(found[0].union(found[1]) if len(found) > 1 else found[0])
        if not more.isEmpty():
            parts = components(links.union(more))
    return parts


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of ``width``-word shingles;
    ``component_id`` is the smallest id that links lead to. Other columns are ignored.
    """
    marks = checkpointed(signed(docs, width))
    named = marks.where("set_key is not null and doc_id is not null")
    classes = checkpointed(named.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    # one row of each class: several rows may share its smallest id
    nodes = named.join(classes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    nodes = checkpointed(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "signature", "bands"))
    parts = checkpointed(class_components(nodes, docs, width, percent))
    of_class = labelled(classes, parts, "node", "component").select("set_key", "component")
    done = marks.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group, all columns as they were; of several rows with
    that id all stay. The list of dropped ids is broadcast only within its bound."""
    found = checkpointed(near_duplicates(docs, width, percent))
    dropped = checkpointed(found.where("not kept").select("doc_id").distinct())
    return only_ids(docs, dropped, dropped.count(), "left_anti").select(*docs.columns)
