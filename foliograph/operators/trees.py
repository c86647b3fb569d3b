"""Trees as adjacency lists ``node_id, parent_id, ord, title``: depth, paths, layout, and outlines from headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions.folds import cut, in_order
from foliograph.functions.text import prefix_parts

STEP, LEAF, PAD = 240.0, 48.0, 16.0


def flattened(nodes: DataFrame) -> DataFrame:
    """``node_id, depth, path``: nodes reached from the roots (null parent), with the titles on the way joined by a slash.

    One join a level, cut at each, until nothing is new; trees of any depth. Nodes whose way up never ends are in a circle: an
    error. Nodes below a parent that isn't there are left out.
    """
    rows = cut(nodes.select("node_id", "parent_id", "title"))
    level = cut(rows.where("parent_id is null").select("node_id", F.lit(0).alias("depth"), F.col("title").alias("path")))
    done, total = level, rows.count()
    while not level.isEmpty():
        below = rows.select("node_id", F.col("parent_id").alias("p"), "title").join(level.select(F.col("node_id").alias("p"), "depth", "path"), "p")
        level = cut(below.select("node_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.col("title")).alias("path")))
        done = done.unionByName(level)
        if done.count() > total:
            raise ValueError("a node is its own ancestor, or two nodes have one id")
    lost = rows.join(done.select("node_id"), "node_id", "left_anti").select("node_id", "parent_id")
    while not lost.isEmpty():
        kept = cut(lost.join(lost.select(F.col("node_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("node_id", "parent_id"))
        if kept.count() == lost.count():
            raise ValueError("a node is its own ancestor")
        lost = kept
    return done


def subtree_pairs(nodes: DataFrame) -> DataFrame:
    """``ancestor, node_id``: every node with itself and each node above it."""
    rows = cut(nodes.select("node_id", "parent_id"))
    step = rows.select("node_id", F.col("node_id").alias("ancestor"))
    done = step
    while not (step := cut(step.join(rows.select(F.col("node_id").alias("ancestor"), F.col("parent_id").alias("up")), "ancestor").where("up is not null").select("node_id", F.col("up").alias("ancestor")))).isEmpty():
        done = done.unionByName(step)
    return done.select("ancestor", "node_id")


def laid_out(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, x, y``: x by depth; leaves below each other, a parent midway between its first and last child.
    A tree is laid out as a whole; trees run side by side."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "node_id"])
        below: dict = {}
        for node, parent in zip(rows.node_id, rows.parent_id, strict=True):
            below.setdefault(None if pd.isna(parent) else parent, []).append(node)
        x, y, lowest = {}, {}, 0.0
        stack = [(n, 0, False) for n in reversed(below.get(None, []))]
        while stack:
            node, depth, done = stack.pop()
            inner = below.get(node, [])
            x[node] = depth * STEP
            if not inner:
                y[node] = lowest
                lowest += LEAF + PAD
            elif done:
                y[node] = (y[inner[0]] + y[inner[-1]]) / 2
            else:
                stack.append((node, depth, True))
                stack += [(n, depth + 1, False) for n in reversed(inner)]
        return pd.DataFrame({"tree_id": rows.tree_id.iloc[0], "node_id": list(x), "x": list(x.values()), "y": [y[n] for n in x]})

    return nodes.select("tree_id", "node_id", "parent_id", "ord").groupBy("tree_id").applyInPandas(place, "tree_id long, node_id long, x double, y double")


def outline(headings: DataFrame) -> DataFrame:
    """Headings (``doc_id, ord, prefix, level``) as a tree: ``doc_id, ord, parent``, parent null at the top.

    A heading goes below the last one of a lower level whose number, where both have one, begins its own. Numbers that begin with 500
    and more, parts of sections that aren't there, and sections more than five beyond the largest so far are dropped.
    """
    rows = headings.select("doc_id", "ord", "level", prefix_parts(F.col("prefix")).alias("parts"))

    def place(above: _Above, row: dict):
        parts, level = tuple(row["parts"]), row["level"]
        if parts and parts[0] >= HIGHEST:
            return []
        above.leave(level, parts)
        if not above.open and parts and not above.follows(parts):
            return []
        parent = above.open[-1][0] if above.open else None
        above.open.append((row["ord"], level, parts))
        return [(row["doc_id"], row["ord"], parent)]

    return in_order(rows, ["doc_id"], ["ord"], "doc_id long, ord long, parent long", _Above, place)


#: section numbers from here on are something else, and how far a top number may be beyond the largest so far (fixed values)
HIGHEST, LEAP = 500, 5


class _Above:
    """The headings that the next one may lie below, and the largest number at the top so far."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, tuple]] = []
        self.largest = 0

    def leave(self, level: int, parts: tuple) -> None:
        while self.open:
            _, held, own = self.open[-1]
            within = not parts or not own or (len(own) < len(parts) and parts[: len(own)] == own)
            if held < level and within:
                return
            self.open.pop()

    def follows(self, parts: tuple) -> bool:
        """Whether a number can stand at the top; the largest is remembered."""
        if len(parts) > 1 or (self.largest and parts[0] > self.largest + LEAP):
            return False
        self.largest = max(self.largest, parts[0])
        return True
