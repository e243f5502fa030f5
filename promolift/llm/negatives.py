"""Hard negatives by a tree of hyperplane cells with distance ranges (GNAT).

The tree is fitted to a bounded sample: every node has up to ``DEGREE`` split
points, and a vector belongs to the child whose split point is nearest. All rows
are indexed. For every leaf the index keeps the least and largest distance of its
rows from each split point of the nodes above it, so of a node's split points
each knows in which range the rows of every sibling lie.

A search asks for rows whose inner product with the anchor lies in a window. As
|a - x|^2 = |a|^2 + |x|^2 - 2 a.x, the window is an annulus around the anchor. A
child is left out as soon as the range of one sibling's split point cannot meet
the annulus. What is left are leaves, whose rows are all compared. Windows are
narrowed first by what the anchor's own leaf holds. So the results are exact.

Leaves are kept as blocks of bounded size; anchors and blocks meet by leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from promolift.llm.common import staged
from promolift.llm.vectors import common_length, matrix, usable

#: Vectors that the split points are chosen from.
SAMPLE = 8192
DEGREE = 8
#: Rows a leaf should have at least, rows of a block at most, about.
LEAF_ROWS, BLOCK_ROWS = 1024, 4096
MOST_LEAVES = 512
#: Anchors that are compared with a block at a time, and that are routed at a time.
TOGETHER, ROUTED = 64, 1024
#: Components of this size or more do not become exact whole numbers; their rows are left out.
MOST_COMPONENT = float(1 << 20)
#: Distances are roots of whole numbers; this is far above their rounding.
SLACK = 1e-6
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Node:
    """Split points, and for each of them a node below or the number of a leaf."""

    points: np.ndarray
    children: list[Node | int] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    inner = a.astype(float) @ b.astype(float).T
    out = (a.astype(float) ** 2).sum(axis=1)[:, None] + (b.astype(float) ** 2).sum(axis=1)[None, :] - 2 * inner
    return np.maximum(out, 0)


def fit_tree(sample: np.ndarray, leaves: int) -> Node:
    """Split points far apart from each other, the same for the same sample."""
    numbers = iter(range(1 << 30))

    def build(rows: np.ndarray, wanted: int) -> Node:
        degree = min(DEGREE, wanted, len(rows))
        chosen = [0]
        nearest = squared(rows, rows[:1])[:, 0]
        while len(chosen) < degree and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(rows, rows[chosen[-1:]])[:, 0])
        node = Node(rows[chosen])
        place = squared(rows, node.points).argmin(axis=1)
        for i in range(len(chosen)):
            own = rows[place == i]
            share = round(wanted * len(own) / len(rows))
            deeper = share > 1 and len(chosen) > 1 and len(own) > 1
            node.children.append(build(own, share) if deeper else next(numbers))
        return node

    return build(sample, max(1, leaves))


def leaf_paths(node: Node, path: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with the split points of all nodes above it, from the root on."""
    path = (*path, node.points)
    for child in node.children:
        if isinstance(child, Node):
            yield from leaf_paths(child, path)
        else:
            yield child, np.vstack(path)


def leaf_of(tree: Node, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector; the first of equally near split points."""
    out = np.zeros(len(vectors), np.int64)

    def go(node: Node, rows: np.ndarray) -> None:
        place = squared(vectors[rows], node.points).argmin(axis=1)
        for i, child in enumerate(node.children):
            below = rows[place == i]
            if isinstance(child, Node):
                go(child, below)
            else:
                out[below] = child

    go(tree, np.arange(len(vectors)))
    return out


@dataclass
class Ranges:
    """Of one subtree: ranges of the distances from split points above it, and of lengths."""

    low: np.ndarray
    high: np.ndarray
    shortest: float
    longest: float


class Router:
    """The tree with the ranges of its subtrees; finds the leaves an annulus can meet."""

    def __init__(self, tree: Node, leaves: dict[int, Ranges]):
        self.tree = tree
        self.leaves = leaves
        self._gather(tree, 0)

    def _gather(self, node: Node, above: int) -> Ranges | None:
        """Ranges of every child, each merged from the leaves under it that have rows."""
        every = []
        node_ranges: list[Ranges | None] = []
        for child in node.children:
            if isinstance(child, Node):
                node_ranges.append(self._gather(child, above + len(node.points)))
            else:
                node_ranges.append(self.leaves.get(child))
        every = [r for r in node_ranges if r is not None]
        node.ranges = [(None if r is None else Ranges(
            r.low[above:above + len(node.points)], r.high[above:above + len(node.points)],
            r.shortest, r.longest)) for r in node_ranges]
        if not every:
            return None
        size = above + len(node.points)
        return Ranges(
            np.min([r.low[:size] for r in every], axis=0), np.max([r.high[:size] for r in every], axis=0),
            min(r.shortest for r in every), max(r.longest for r in every))

    def leaves_for(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """Leaf to the places of the anchors whose window of scores (low to high) it may hold."""
        found: dict[int, np.ndarray] = {}
        lengths = (anchors.astype(float) ** 2).sum(axis=1)

        def go(node: Node, rows: np.ndarray) -> None:
            near = np.sqrt(squared(anchors[rows], node.points))
            for child, ranges in zip(node.children, node.ranges, strict=True):
                if ranges is None:
                    continue
                # The annulus of distances that the window means for rows of these lengths.
                inner = np.sqrt(np.maximum(lengths[rows] + ranges.shortest - 2 * high[rows], 0))
                outer_square = lengths[rows] + ranges.longest - 2 * low[rows]
                outer = np.sqrt(np.maximum(outer_square, 0))
                least = np.maximum(near - ranges.high, ranges.low - near).max(axis=1)
                most = (near + ranges.high).min(axis=1)
                slack = SLACK * (1 + near.max(axis=1, initial=0) + outer)
                meets = (outer_square >= -slack) & (least <= outer + slack) & (most >= inner - slack)
                if not meets.any():
                    continue
                if isinstance(child, Node):
                    go(child, rows[meets])
                else:
                    found[child] = rows[meets]

        if len(anchors):
            go(self.tree, np.arange(len(anchors)))
        return found


VECTOR = np.dtype("<i4")


def packed(array: np.ndarray, kind: np.dtype | str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def whole_vectors(frame: DataFrame, scale: int, key: str, label: str, vector: str) -> tuple[DataFrame, int]:
    """``id, label, vector`` of the rows that take part, one for each id, staged; their length.

    ``vector`` holds floor(scale * component) as binary little-endian 32-bit numbers.
    """
    fine = frame.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).alias("vector"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector", MOST_COMPONENT))
    length = common_length(fine, "vector")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = np.floor(scale * matrix(batch.column(2), length)).astype(VECTOR)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([row.tobytes() for row in whole], pa.binary())],
                    ["id", "label", "vector"])

    if not length:
        made = fine.select("id", "label", F.lit(None).cast("binary").alias("vector"))
    else:
        made = fine.where(F.size("vector") == length).mapInArrow(build, "id bigint, label bigint, vector binary")
    one = made.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return staged(one.select("id", "row.label", "row.vector"), "vectors"), length


@dataclass
class Index:
    """Packed blocks of leaves (a staged table), and how to find the leaves of a window."""

    blocks: DataFrame
    router: Router | None
    length: int
    #: Of each leaf with rows, one more than its last block.
    n_blocks: dict[int, int] = field(default_factory=dict)


def unpacked(values, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), VECTOR).reshape(-1, length)


def smallest_hashes(rows: DataFrame, count: int) -> list[Row]:
    """The ``SAMPLE`` of ``count`` rows with the smallest hashes.

    Every task sends the driver as many rows as are asked for, so rows with larger
    hashes than twice as many should have are left out before that.
    """
    hashed = rows.select("vector", F.xxhash64("id").alias("h"), "id")
    share = 2 * SAMPLE / max(1, count)
    while True:
        few = hashed if share >= 1 else hashed.where(F.col("h") < int(share * 2.0 ** 64) - (1 << 63))
        sample = few.orderBy("h", "id").limit(SAMPLE).collect()
        if share >= 1 or len(sample) == SAMPLE:
            return sample
        share *= 2


def build_index(rows: DataFrame, length: int) -> Index:
    """Index every row of :func:`whole_vectors`. The split points come from ``SAMPLE`` rows with the smallest hashes."""
    count = rows.count()
    leaves = max(1, min(MOST_LEAVES, count // LEAF_ROWS))
    sample = smallest_hashes(rows, count)
    if not sample:
        return Index(rows.select(F.lit(0).alias("leaf"), F.lit(0).alias("block")), None, 0)
    tree = fit_tree(unpacked([r["vector"] for r in sample], length), leaves)
    paths = dict(leaf_paths(tree))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=leaf_of(tree, unpacked(batch["vector"], length)))

    placed = staged(rows.mapInPandas(place, "id bigint, label bigint, vector binary, leaf bigint"), "placed")
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks"))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        vectors = unpacked(group["vector"], length)
        apart = np.sqrt(squared(vectors, paths[key[0]]))
        lengths = (vectors.astype(float) ** 2).sum(axis=1)
        return pd.DataFrame([{
            "leaf": key[0], "block": key[1], "ids": packed(group["id"], "<i8"),
            "labels": packed(group["label"], "<i8"), "vectors": packed(vectors, VECTOR),
            "low": apart.min(axis=0).tolist(), "high": apart.max(axis=0).tolist(),
            "shortest": lengths.min(), "longest": lengths.max()}])

    dealt = placed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    table = staged(dealt.select("leaf", "block", "id", "label", "vector").groupBy("leaf", "block").applyInPandas(
        pack, "leaf bigint, block int, ids binary, labels binary, vectors binary, "
              "low array<double>, high array<double>, shortest double, longest double"), "blocks")
    # Bounded by the leaves of the tree, whatever the number of rows.
    ends = table.select("leaf", "shortest", "longest", F.posexplode(F.arrays_zip("low", "high")).alias("at", "r"))
    found: dict[int, Ranges] = {}
    dealt_into = {r["leaf"]: r["n"] for r in table.groupBy("leaf").agg((F.max("block") + 1).alias("n")).collect()}
    for leaf in ends.groupBy("leaf", "at").agg(
            F.min("r.low").alias("low"), F.max("r.high").alias("high"), F.min("shortest").alias("shortest"),
            F.max("longest").alias("longest")).groupBy("leaf").agg(
                F.array_sort(F.collect_list(F.struct("at", "low", "high", "shortest", "longest"))).alias("r")).collect():
        r = leaf["r"]
        found[leaf["leaf"]] = Ranges(
            np.array([x["low"] for x in r]), np.array([x["high"] for x in r]),
            min(x["shortest"] for x in r), max(x["longest"] for x in r))
    return Index(table, Router(tree, found), length, dealt_into)


#: An anchor with its windows and the leaves they may meet, each with the number of its blocks.
ASKED = (
    "id bigint, label bigint, vector binary, slots array<int>, lows array<bigint>, highs array<bigint>, "
    "targets array<struct<leaf:bigint,n_blocks:int>>")
HIT = "id bigint, slot int, other bigint, score bigint"


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(index: Index, queries: DataFrame, top: int, same_label: bool, own_leaf: bool) -> DataFrame:
    """``id, slot, other, score``: the first ``top`` rows of every query's window, score falling, id rising.

    A query has ``id, label, vector, slot, low, high``; label and vector are those
    of its id. Rows of its own id are left out, and those of the other kind of
    label. With ``own_leaf`` only the leaf where the query itself belongs is looked at.
    """
    router, length, n_blocks = index.router, index.length, index.n_blocks

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROUTED):
                batch = whole.slice(start, ROUTED)
                vectors = unpacked(batch.column("vector").to_pylist(), length)
                if own_leaf:
                    at, leaves = np.arange(len(vectors)), leaf_of(router.tree, vectors)
                else:
                    who = np.repeat(np.arange(len(vectors)), pc.list_value_length(batch.column("slots")).to_numpy())
                    low, high = (batch.column(name).flatten().to_numpy().astype(float) for name in ("lows", "highs"))
                    found = router.leaves_for(vectors[who], low, high)
                    met = [(np.unique(who[rows]), leaf) for leaf, rows in found.items()]
                    at = np.concatenate([rows for rows, _ in met] or [np.zeros(0, np.int64)])
                    leaves = np.repeat([leaf for _, leaf in met], [len(rows) for rows, _ in met]).astype(np.int64)
                kept = np.array([leaf in n_blocks for leaf in leaves.tolist()], bool)
                at, leaves = at[kept], leaves[kept]
                order = np.argsort(at, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vectors)))])
                targets = pa.StructArray.from_arrays([
                    pa.array(leaves[order], pa.int64()),
                    pa.array([n_blocks[leaf] for leaf in leaves[order].tolist()], pa.int32())], ["leaf", "n_blocks"])
                columns = ["id", "label", "vector", "slots", "lows", "highs"]
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), targets)],
                    [*columns, "targets"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block comes before the anchors that were sent to it."""
        here, ids, labels, vectors = None, None, None, None
        for batch in batches:
            leaf, block, kind = (batch.column(name).to_numpy() for name in ("leaf", "block", "kind"))
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            runs = [0, *edges.tolist(), batch.num_rows]
            for begin, end in zip(runs, runs[1:]):
                if begin == end:
                    continue
                if kind[begin] == 0:
                    here = (leaf[begin], block[begin])
                    ids, labels = (np.frombuffer(batch.column(name)[begin].as_py(), "<i8") for name in ("ids", "labels"))
                    vectors = unpacked([batch.column("vector")[begin].as_py()], length)
                    continue
                if here != (leaf[begin], block[begin]):
                    continue  # no row was dealt into the block
                for start in range(begin, end, TOGETHER):
                    part = batch.slice(start, min(TOGETHER, end - start))
                    hits = _hits(part, ids, labels, vectors)
                    if hits.num_rows:
                        yield hits

    def _hits(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """The first rows of the block for every window of some anchors."""
        own, own_label = (part.column(name).to_numpy() for name in ("id", "label"))
        who = np.repeat(np.arange(len(own)), pc.list_value_length(part.column("slots")).to_numpy())
        slot, low, high = (part.column(name).flatten().to_numpy() for name in ("slots", "lows", "highs"))
        scores = inner_products(unpacked(part.column("vector").to_pylist(), length), vectors)
        allowed = (ids[None, :] != own[:, None]) & ((labels[None, :] == own_label[:, None]) == same_label)
        q, x = np.nonzero(allowed[who] & (scores[who] >= low[:, None]) & (scores[who] <= high[:, None]))
        reached = scores[who[q], x]
        order = np.lexsort((ids[x], -reached, q))
        q, x, reached = q[order], x[order], reached[order]
        first = np.arange(len(q)) - np.searchsorted(q, np.arange(len(who)))[q] < top
        q, x, reached = q[first], x[first], reached[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(own[who[q]], pa.int64()), pa.array(slot[q], pa.int32()), pa.array(ids[x], pa.int64()),
             pa.array(reached, pa.int64())], ["id", "slot", "other", "score"])

    # An anchor's windows share its vector, which is sent to a block and compared with its rows once.
    by_anchor = queries.groupBy("id").agg(
        F.min("label").alias("label"), F.min("vector").alias("vector"),
        F.collect_list(F.struct("slot", "low", "high")).alias("windows")).select(
            "id", "label", "vector", F.col("windows.slot").alias("slots"), F.col("windows.low").alias("lows"),
            F.col("windows.high").alias("highs"))
    # Anchors are copied for each block by rows, never joined: a copy for every leaf is
    # far larger than Spark takes it for, and would be broadcast through the driver.
    asked = by_anchor.mapInArrow(route, ASKED).withColumn("target", F.explode("targets")).drop("targets")
    sent = asked.select(
        F.col("target.leaf").alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("target.n_blocks") - 1)).alias("block"),
        F.lit(1).alias("kind"), "id", "label", "vector", "slots", "lows", "highs")
    held = index.blocks.select(
        "leaf", "block", F.lit(0).alias("kind"), F.col("vectors").alias("vector"), "ids", "labels")
    meeting = held.unionByName(sent, allowMissingColumns=True).repartition("leaf", "block").sortWithinPartitions(
        "leaf", "block", "kind")
    hits = meeting.mapInArrow(compare, HIT)
    falling = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other")
    return hits.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)


def narrowed(queries: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """Raise the lower ends of windows to the score of the last of ``top`` rows found so far."""
    full = found.where(F.col("rank") == top).select("id", "slot", F.col("score").alias("reached"))
    return queries.join(full, ["id", "slot"], "left").select(
        "id", "label", "vector", "slot", F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high")


def first_of(index: Index, queries: DataFrame, top: int, same_label: bool) -> DataFrame:
    """:func:`search` over all leaves, after the own leaf has narrowed the windows."""
    near = search(index, queries, top, same_label, own_leaf=True)
    windows = staged(narrowed(queries, near, top), "windows")
    return search(index, windows, top, same_label, own_leaf=False)


def hard_negatives(
    frame: DataFrame, anchor: Column, label: str = "label", scale: int = 256, positives: int = 5, top: int = 10,
    low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says of an ``id`` whether it is an anchor. Its positives are the
    first rows of its label; for each, the first ``top`` rows of other labels
    whose score is from ``low`` to ``high`` per cent of the positive's. Windows
    of negative positives' scores are empty.

    Rows with a null id or label, a null vector, a null or non-finite component
    or one of 2^20 or more in size, and vectors of another length than most take
    no part. Of rows with one id the smallest label, then the smallest vector
    counts. Ties go to the smaller id. Anchors without positives and positives
    without negatives give no rows, nor does an empty table. Other columns are
    not read.
    """
    rows, length = whole_vectors(frame, scale, "vec_id", label, "embedding")
    index = build_index(rows, length)
    if index.router is None:
        return frame.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                "negative_score bigint")
    anchors = rows.where(anchor)
    asked = staged(anchors.select(
        "id", "label", "vector", F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")), "asked")
    liked = staged(first_of(index, asked, positives, same_label=True).select(
        "id", F.col("rank").alias("slot"), F.col("other").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    windows = staged(asked.drop("slot", "low", "high").join(liked, "id").select(
        "id", "label", "vector", "slot",
        F.ceil(F.expr(f"cast({low} * positive_score as decimal(38,0)) / 100")).cast("bigint").alias("low"),
        F.floor(F.expr(f"cast({high} * positive_score as decimal(38,0)) / 100")).cast("bigint").alias("high"),
    ).where("low <= high"), "asked")
    found = first_of(index, windows, top, same_label=False)
    return found.join(liked, ["id", "slot"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
