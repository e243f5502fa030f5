"""Shards of equal row counts that keep linked documents together.

Balanced label propagation. All documents are dealt to the shards evenly in hash
order, which fixes the size of every shard. In every round a group of linked
documents (equal texts) elects the shards that hold most of it, one if it fits
into one and else as many as it takes; its other members ask to move there. What
is let in keeps every size: a document moves along a circle of shards whose
documents want each other's places, or to the place of a document without links,
which may lie anywhere. Circles are sought in the shards x shards counts of
wishes, so they cost the same for any number of documents.

Elections are of two kinds, in turn. By size, a group elects as if shards were
empty, which lets fully linked corpora swap; by room, it counts only its own
members and the places free of linked documents, so that a group whose shards
are full goes on to others. Members only move to a shard that holds as many of
their group or more, so the sum of squares of these numbers grows with every move
and the rounds end by themselves, when an election of either kind moves none.
Equal shards are ranked anew in every round, for groups that had no circle.
Documents without links fill every shard up to its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import crc_of_text, running_start, spread, staged, whole_text

SHARDS, ROW_BYTES = 40, 16
GROUP = ["g1", "g2"]


def numbered_in(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """Add a gapless 0-based number within ``group`` in hash order of ``row``.

    A window only sorts one of many hash buckets of a group.
    """
    buckets = spread(rows.sparkSession)
    dealt = rows.withColumns({
        "_mix": F.xxhash64(F.lit(7), "row"), "_one": F.lit(1),
        "_bucket": F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(buckets)).cast("int")})
    placed = running_start(dealt, group, "_bucket", ["_mix", "row"], "_one", name)
    return placed.drop("_mix", "_one", "_bucket")


def start_labels(rows: DataFrame, shards: int) -> DataFrame:
    """Deal all rows in hash order: counts differ by one at most."""
    placed = numbered_in(rows.withColumn("all", F.lit(0)), ["all"], "position")
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).drop("position", "all")


def elected(linked: DataFrame, room: DataFrame, turn: int, by_room: bool) -> DataFrame:
    """Members that ask to move: ``row, shard, target``.

    A group ranks its shards by the members they hold and elects the first ones
    that together have places for all. Its other members ask for these places in
    order; no more ask than there are.
    """
    whole = Window.partitionBy(*GROUP)
    held = linked.groupBy(*GROUP, "shard").agg(F.count("*").alias("n")).withColumns({
        "members": F.sum("n").over(whole), "shards": F.count("*").over(whole)})
    # Of equal shards those with room for more of the group come first.
    ranked = whole.orderBy(
        F.desc("n"), F.desc(F.least(F.col("room"), F.col("members") - F.col("n"))),
        F.xxhash64(F.lit(turn), *GROUP, "shard"), "shard")
    so_far = ranked.rowsBetween(Window.unboundedPreceding, -1)
    places = (F.col("n") + F.col("room")) if by_room else F.greatest("n", "size")
    weighed = held.join(room, "shard").withColumn("places", places).select(
        *GROUP, "shard", "n", (F.col("places") - F.col("n")).alias("vacant"),
        F.coalesce(F.sum("places").over(so_far), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.col("places") - F.col("n")).over(so_far), F.lit(0)).alias("start"),
        "members", "shards")
    chosen = F.col("before") < F.col("members")
    targets = weighed.where((F.col("shards") > 1) & chosen).groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct(
            (F.col("start") + F.col("vacant")).alias("end"), F.col("shard").alias("target")))).alias("targets"))
    leaving = weighed.where(~chosen).select(*GROUP, "shard").join(targets, GROUP)
    placed = numbered_in(
        even_join(linked, leaving.select(*GROUP, "shard"), [*GROUP, "shard"], "inner"), GROUP, "place")
    asking = even_join(placed, targets, GROUP, "inner")
    open_ = F.filter("targets", lambda t: t["end"] > F.col("place"))
    return asking.select("row", "shard", F.get(open_, F.lit(0))["target"].alias("target")).where(
        "target is not null")


def circulation(wishes: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the ``wishes`` (from, to) can be met without changing any count.

    Circles of wishes are taken until there is none. Then documents without links
    (``room``) change places with those that want theirs, which makes room where
    these came from.
    """
    left: dict[int, dict[int, int]] = {}
    for (start, end), n in sorted(wishes.items()):
        left.setdefault(start, {})[end] = n
    met: dict[tuple[int, int], int] = {}

    def meet(start: int, end: int, n: int) -> None:
        left[start][end] -= n
        met[start, end] = met.get((start, end), 0) + n

    done: set[int] = set()  # no circle leads through these any more
    for first in left:
        path = [first]
        while path:
            onward = next((to for to, n in left.get(path[-1], {}).items() if n and to not in done), None)
            if onward is None:
                done.add(path.pop())
            elif onward not in path:
                path.append(onward)
            else:
                at = path.index(onward)
                edges = list(zip(path[at:], [*path[at + 1:], onward], strict=True))
                n = min(left[start][end] for start, end in edges)
                for start, end in edges:
                    meet(start, end, n)
                del path[at + 1:]
    free, moved = dict(room), True
    while moved:
        moved = False
        for start, end in sorted(wishes):
            n = min(left[start][end], free.get(end, 0))
            if n > 0:
                meet(start, end, n)
                free[end] -= n
                free[start] = free.get(start, 0) + n
                moved = True
    return met


def propagated(linked: DataFrame, sizes: DataFrame, turn: int, by_room: bool) -> tuple[DataFrame, bool]:
    """One round: the new labels of the linked documents and whether any moved."""
    taken = linked.groupBy("shard").agg(F.count("*").alias("taken"))
    room = sizes.join(taken, "shard", "left").select(
        "shard", "size", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("room"))
    asking = staged(elected(linked, room, turn, by_room), "asking")
    wishes = {(r["shard"], r["target"]): r["count"] for r in asking.groupBy("shard", "target").count().collect()}
    met = circulation(wishes, {r["shard"]: r["room"] for r in room.collect()}) if wishes else {}
    if not met:
        return linked, False
    quota = linked.sparkSession.createDataFrame(
        [(*pair, n) for pair, n in met.items()], "shard int, target int, quota bigint")
    moves = numbered_in(asking, ["shard", "target"], "place").join(
        F.broadcast(quota), ["shard", "target"]).where(F.col("place") < F.col("quota")).select(
        "row", F.col("target").alias("new"))
    relabelled = linked.join(moves, "row", "left").withColumn("shard", F.coalesce("new", "shard"))
    moved = staged(relabelled.drop("new"), "labels")
    return moved, True


def rounds(linked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rounds until elections by size and by room in turn move no document."""
    turn = still = 0
    while still < 2:
        linked, moved = propagated(linked, sizes, turn, turn % 2 == 1)
        turn, still = turn + 1, 0 if moved else still + 1
    return linked


def label_propagation(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row, shard`` for ``rows`` of ``row`` (unique) and the link group ``g1, g2``.

    Groups of more than a fourth of a shard go first, as if the others had no
    links; else these would lie together in the places that a large group needs.
    An empty table stays empty.
    """
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("members"))
    dealt = staged(start_labels(even_join(rows, groups, GROUP, "inner"), shards), "dealt")
    sizes = staged(dealt.groupBy("shard").agg(F.count("*").alias("size")), "sizes")
    room = sizes.agg(F.max("size")).first()[0] or 0
    large = (F.col("members") > 1) & (4 * F.col("members") > room)
    if not dealt.where(large).isEmpty():
        settled = rounds(dealt.where(large), sizes)
        others = filled(dealt.where(~large), settled, sizes)
        dealt = staged(settled.unionByName(dealt.drop("shard").join(others, "row")), "dealt")
    linked = rounds(dealt.where("members > 1"), sizes)
    return linked.select("row", "shard").unionByName(filled(dealt.where("members = 1"), linked, sizes))


def filled(free: DataFrame, linked: DataFrame, sizes: DataFrame) -> DataFrame:
    """``row, shard`` of the ``free`` documents: they fill the shards in order.

    Only one number for each shard comes to the driver.
    """
    taken = linked.groupBy("shard").agg(F.count("*").alias("taken"))
    left = {r["shard"]: r["size"] - r["taken"] for r in sizes.join(taken, "shard", "left").select(
        "shard", "size", F.coalesce("taken", F.lit(0)).alias("taken")).collect()}
    ends = np.cumsum([left[shard] for shard in sorted(left)]).tolist()
    placed = numbered_in(free.select("row", F.lit(0).alias("all")), ["all"], "place")
    ended = F.size(F.filter(F.array(*[F.lit(end) for end in ends]), lambda end: end <= F.col("place")))
    return placed.select("row", ended.cast("int").alias("shard"))


def cut_links(labels: DataFrame) -> DataFrame:
    """Links (a chain through each group) that the shards cut; ``labels`` has the groups."""
    per_group = labels.groupBy(*GROUP).agg(
        (F.count_distinct("shard") - 1).alias("cut"))
    return per_group.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``rows``: shard counts differ by one at most. A null text has no
    bytes and equals the empty one. Repeated rows are rows of their own, linked
    with each other.
    """
    text = whole_text()
    rows = staged(docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        crc_of_text(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
        F.monotonically_increasing_id().alias("row")), "rows")
    labels = label_propagation(rows.select("row", *GROUP), shards)
    slots = numbered_in(labels.select("row", "shard"), ["shard"], "slot")
    return rows.join(slots, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
