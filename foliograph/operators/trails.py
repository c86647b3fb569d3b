"""Reading history: clicks waiting for the paper they lead to, caps and lifetimes, and bursts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions.folds import in_order, laid_out, so_far

#: how long a click waits (fixed values): minutes, and how many wait at most
LIFETIME_MINUTES = 10
WAITING = 5
TRAILS = 8


def take_click(minutes: int = LIFETIME_MINUTES, most: int = WAITING):
    """The step of ``matched``: what is held are the clicks that wait, as ``at, event_id, title, fragment``, in order of arrival."""
    oldest = minutes * 60 * 1_000_000

    def step(held: list, row: dict):
        if row["kind"] == 0:
            held[:] = [*held, (row["at"], row["event_id"], row["title"], row["fragment"])][-most:]
            return []
        held[:] = [c for c in held if row["at"] - c[0] <= oldest]  # what is too old now will be later
        for at, event_id, title, fragment in held:
            if T.similar_titles(row["title"], title) or (fragment and fragment in (row["fragment"] or "")):
                held[:] = [c for c in held if c[0] != at]
                return [(row["event_id"], event_id)]
        return []

    return step


def both_sides(first: DataFrame, second: DataFrame, *columns: str) -> DataFrame:
    """Rows of both with ``kind``, 0 and 1, ``at`` in microseconds, ``event_id`` and ``columns``."""
    side = lambda t, kind: t.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(kind).alias("kind"), "event_id", *columns)
    return side(first, 0).unionByName(side(second, 1))


def titled(rows: DataFrame) -> DataFrame:
    """Rows with titles and addresses as they are compared."""
    return rows.withColumn("title", T.normalize_title(F.col("title"))).withColumn("fragment", T.url_fragment(F.col("url")))


def matched(clicks: DataFrame, opened: DataFrame, minutes: int = LIFETIME_MINUTES, most: int = WAITING) -> DataFrame:
    """Each opened paper with the click that led to it: ``open_id, click_id``.

    Both sides have ``user_id, event_id, ts, title, url``. A user's last ``most`` clicks wait; a paper takes the first of them that is
    ``minutes`` old at most and agrees with it: equal or similar titles (as ``titles_match``), or the paper's address holds the
    click's. A click that is taken is gone, and so are others of that very time. At one time clicks come before papers, and
    ids decide. A pass over each user's events in order, a busy user's in parts; the state is ``most`` clicks. Rows without a user match nothing.
    """
    rows = both_sides(titled(clicks), titled(opened), "user_id", "title", "fragment").where("user_id is not null")
    return in_order(rows, ["user_id"], ["at", "kind", "event_id"], "open_id long, click_id long", list, take_click(minutes, most))


def waiting(clicks: DataFrame, most: int = WAITING) -> DataFrame:
    """The last ``most`` clicks of each user. Spark keeps that many of each user in each task before it shuffles."""
    return clicks.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(f"nth <= {most}").select("user_id", "event_id", "nth")


def fresh(clicks: DataFrame, now, minutes: int = LIFETIME_MINUTES) -> DataFrame:
    """Clicks less than ``minutes`` old at ``now``; one exactly as old is stale."""
    return clicks.where(F.col("ts") > now - F.expr(f"INTERVAL {minutes} MINUTES"))


def pruned(trails: DataFrame, most: int = TRAILS) -> DataFrame:
    """Each user's trails; beyond ``most`` the one longest unread that has no star goes. Counts and the oldest combine before they are shuffled."""
    oldest = F.min(F.when(~F.col("starred"), F.struct("last_ts", "trail_id")))["trail_id"]
    gone = trails.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), oldest.alias("trail_id")).where(F.col("n") > most).select("user_id", "trail_id")
    return trails.join(gone, ["user_id", "trail_id"], "left_anti").select(*trails.columns)


def settled(events: DataFrame, seconds: float) -> DataFrame:
    """The last event of each burst: the user's next one is more than ``seconds`` later, or there is none."""
    order = ["at", "event_id"]
    rows = laid_out(events.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), ["user_id"], order, falling=True)
    rows = so_far(rows, ["user_id"], order, last={"after": F.col("at")}, falling=True)
    return rows.where(F.coalesce(F.col("after") - F.col("at") > seconds * 1_000_000, F.lit(True))).select("user_id", "event_id", "ts")


def milestones(events: DataFrame) -> DataFrame:
    """Events whose value is the largest of their user so far: each height is reached once."""
    rows = so_far(laid_out(events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], most={"before": F.col("value")})
    return rows.where(F.coalesce(F.col("value") > F.col("before"), F.lit(True))).select("user_id", "event_id", "value")


def connected(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where matched papers go in the trails: ``open_id, trail_id, parent_id, new``. ``matches`` has ``open_id, source`` (the normalised title
    that the click came from), ``nodes`` has ``trail_id, node_id, title_norm, ord``: the first node of that title is the parent;
    without one a new trail begins, named by the match."""
    first = nodes.where("title_norm <> ''").groupBy("title_norm").agg(F.min(F.struct("ord", "trail_id", "node_id")).alias("n"))
    out = matches.join(first, F.col("source") == F.col("title_norm"), "left")
    return out.select("open_id", F.coalesce("n.trail_id", "open_id").alias("trail_id"), F.col("n.node_id").alias("parent_id"), F.col("n").isNull().alias("new"))


def added_children(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Trail nodes (``trail_id, parent_id, node_id, title_norm, ord``) with the children that aren't there yet: of one parent and title the
    node that was there, else the first child; children without a title always come in."""
    rows = nodes.withColumn("new", F.lit(0)).unionByName(children.withColumn("new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("trail_id", "parent_id", "title_norm").orderBy("new", "ord", "node_id"))
    return rows.withColumn("nth", nth).where((F.col("nth") == 1) | (F.col("new") == 0) | (F.coalesce("title_norm", F.lit("")) == "")).drop("nth", "new")


def shown(trails: DataFrame, nodes: DataFrame, title: str, others: int = 5) -> DataFrame:
    """Each user's trails in the order that they are shown in: those with a node of ``title``, then ``others`` more; stars first, then
    the last read. ``user_id, trail_id, current, place``."""
    here = nodes.where(F.col("title_norm") == title).select("trail_id").distinct().withColumn("current", F.lit(True))
    rows = trails.join(here, "trail_id", "left").withColumn("current", F.coalesce("current", F.lit(False)))
    first = Window.partitionBy("user_id").orderBy(F.desc("starred"), F.desc("last_ts"), "trail_id")
    kept = rows.where("not current").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= others).drop("nth").unionByName(rows.where("current"))
    order = ["other", "plain", "unread", "trail_id"]
    placed = kept.select("user_id", "trail_id", "current", (~F.col("current")).alias("other"), (~F.col("starred")).alias("plain"), (-F.unix_micros(F.col("last_ts").cast("timestamp"))).alias("unread"))
    placed = so_far(laid_out(placed, ["user_id"], order), ["user_id"], order, sums={"place": F.lit(1)})
    return placed.select("user_id", "trail_id", "current", F.coalesce("place", F.lit(0)).cast("int").alias("place"))


#: how long an answer is kept, and how far apart requests are, in seconds; how long a permission to pass lasts (fixed values)
KEPT, APART, PASS = 300, 2, 5


def look_up(kept: float = KEPT):
    """The step of ``looked_up``: what is held is when the last successful request went out."""

    def step(held: list, row: dict):
        real = not held or row["at"] - held[0][0] >= kept * 1_000_000
        if real and row["ok"]:
            held[:] = [(row["at"],)]
        return [(row["client"], row["key"], row["event_id"], row["at"], real)]

    return step


LOOKED_UP = "client long, key long, event_id long, at long, real boolean"


def looked_up(requests: DataFrame, kept: float = KEPT) -> DataFrame:
    """Requests (``client, key, event_id, ts, ok``) with ``real``: whether one goes out, as no successful one of its client and key did less
    than ``kept`` seconds before. A pass over each key's requests in order."""
    rows = requests.select("client", "key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")
    return in_order(rows, ["client", "key"], ["at", "event_id"], LOOKED_UP, list, look_up(kept))


def spaced(real: DataFrame, apart: float = APART) -> DataFrame:
    """When requests of a client (``client, event_id, at`` in microseconds) go out, ``apart`` seconds after the one before at least: the latest
    of any earlier request's time and the steps since."""
    step, order = F.lit(int(apart * 1_000_000)), ["at", "event_id"]
    rows = so_far(laid_out(real, ["client"], order), ["client"], order, sums={"nth": F.lit(1)})
    rows = rows.withColumn("nth", F.coalesce("nth", F.lit(0))).withColumn("slack", F.col("at") - F.col("nth") * step)
    rows = so_far(rows, ["client"], order, most={"before": F.col("slack")})
    return rows.withColumn("starts", F.greatest("before", "slack") + F.col("nth") * step).select(*real.columns, "starts")


def let_pass(seconds: float = PASS):
    """The step of ``passed``: what is held is the last permission, until a view uses it."""

    def step(held: list, row: dict):
        if row["kind"] == 0:
            held[:] = [(row["at"], row["event_id"])]
            return []
        given, held[:] = held[:], []
        return [(row["event_id"], given[0][1])] if given and row["at"] - given[0][0] <= seconds * 1_000_000 else []

    return step


def passed(permits: DataFrame, pages: DataFrame, seconds: float = PASS) -> DataFrame:
    """Page views that pass by a permission for their address: ``page_id, permit_id``. A permission (``url, event_id, ts``) lasts ``seconds``, a
    later one takes its place, and the first view uses it up."""
    rows = both_sides(permits, pages, "url").where("url is not null")
    return in_order(rows, ["url"], ["at", "kind", "event_id"], "page_id long, permit_id long", list, let_pass(seconds))


def progress(events: DataFrame, sections: DataFrame) -> DataFrame:
    """The first event of each user that reaches each section: ``user_id, section_no, event_id``. ``events`` have ``user_id, event_id, ts, progress`` (a share
    of the document), ``sections`` ``section_no, position``; a section is reached a hundredth before its place.

    Only a user's milestones reach sections for the first time: those between the height before and the new one, which are sought by
    hundredths of the document, so that neither side goes to every task.
    """
    order = ["ts", "event_id"]
    rows = laid_out(events.select("user_id", "event_id", "ts", "progress").where("progress is not null"), ["user_id"], order)
    rows = so_far(rows, ["user_id"], order, most={"before": F.col("progress")}).where("before is null or progress > before")
    hundredth = lambda c: F.least(F.greatest(F.floor(c * 100), F.lit(-2)), F.lit(102))
    rows = rows.withColumn("cell", F.explode(F.sequence(F.coalesce(hundredth(F.col("before")), F.lit(-2)), hundredth(F.col("progress")))))
    marks = sections.select("section_no", (F.col("position") - 0.01).alias("place"), hundredth(F.col("position") - 0.01).alias("cell"))
    met = rows.join(marks, "cell").where("progress >= place and (before is null or before < place)")
    return met.select("user_id", "section_no", "event_id")


def slot_taken(puts: DataFrame, takes: DataFrame) -> DataFrame:
    """What each take from a slot gets: ``take_id, put_id``. ``puts`` and ``takes`` have ``slot, event_id, ts``; a slot holds the last put, and a take empties
    it; a take from an empty slot gets nothing."""
    order = ["at", "kind", "event_id"]
    rows = so_far(laid_out(both_sides(puts, takes, "slot"), ["slot"], order), ["slot"], order, last={"before": F.struct("kind", "event_id")})
    return rows.where("kind = 1 and before.kind = 0").select(F.col("event_id").alias("take_id"), F.col("before.event_id").alias("put_id"))
