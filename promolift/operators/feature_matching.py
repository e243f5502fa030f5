"""Clusters of bounded size and pairs of like customers, both by all features.

Customers are described by scaled features, here what they spent in each week.
A cluster above a bound is halved across its widest feature until all its parts
are within it. Pairs are found in rounds: customers are placed on a few random
lines, neighbours of different arms on a line offer themselves to each other,
and a pair is made where each is the other's best offer. An offer costs a fixed
number of rows a customer, so no two arms are ever paired as a whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift.functions import vocabulary as V
from promolift.functions.joins import even_join
from promolift.functions.ranks import with_position
from promolift.operators.matching import one_to_one_match
from promolift.sources.sinks import shared_folder, stage

#: Random lines a round, and customers of a line that are sorted together.
LINES, BLOCK = 4, 4096
#: Steps a unit of a scaled feature is cut into where customers are placed by it.
STEPS = 1000
FEATURE = np.dtype("<f8")
KEPT = ["cluster", "id", "is_control"]


def with_features(candidates: DataFrame, pivot: DataFrame) -> DataFrame:
    """Candidates with ``features``: the columns of ``pivot`` but ``id``, each with mean 0 and deviation 1.

    One row per cluster and customer. Customers without ``id``, cluster or arm,
    and those in both arms of a cluster, take no part. A missing or NaN feature
    is 0 before it is scaled, one that never differs is 0 throughout. Runs a job
    that writes the unscaled features when called, so they are worked out once.
    """
    names = [name for name in pivot.columns if name != "id"]
    raw = pivot.select("id", F.array(*[
        F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) for name in names]).alias("_raw"))
    raw = raw.groupBy("id").agg(F.min("_raw").alias("_raw"))
    value = lambda i: F.coalesce(F.col("_raw")[i], F.lit(0.0))
    arm = F.col("event_control_flag")
    rest = [name for name in candidates.columns if name not in ("id", "cluster", "event_control_flag")]
    once = candidates.filter(arm.isNotNull()).groupBy("cluster", "id").agg(
        F.min(arm).alias("event_control_flag"), F.max(arm).alias("_other"),
        *[F.min(name).alias(name) for name in rest])
    once = once.filter("_other = event_control_flag and id is not null and cluster is not null").drop("_other")
    joined = once.join(raw, "id", "left")
    if not names:
        return joined.withColumn("features", F.array().cast("array<double>")).drop("_raw")
    joined = stage(joined, f"{shared_folder(joined.sparkSession)}/features")
    # A row for each task.
    parts = [(row.n, np.array(row.mean), np.array(row.squares)) for row in joined.select("_raw").mapInArrow(
        _moments(len(names)), "n bigint, mean array<double>, squares array<double>").collect()]
    if parts:
        customers, mean, squares = reduce(_merged, parts)
        deviation = np.sqrt(squares / customers).tolist()
        scaled = [
            (value(i) - F.lit(m)) / F.lit(d) if d else F.lit(0.0)
            for i, (m, d) in enumerate(zip(mean.tolist(), deviation, strict=True))]
    else:
        scaled = [F.lit(0.0)] * len(names)
    return joined.withColumn("features", F.array(*scaled)).drop("_raw")


def _merged(one: tuple, other: tuple) -> tuple:
    """Count, mean and squared distances from the mean of two sets of rows together."""
    (n, mean, squares), (m, their_mean, their_squares) = one, other
    apart = their_mean - mean
    return n + m, mean + apart * (m / (n + m)), squares + their_squares + apart * apart * (n * m / (n + m))


def _moments(size: int):
    """A task's count, means and squared distances; a value that all rows share is met exactly."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(0)
                rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                rows = np.vstack([rows, np.zeros((lists.null_count, size))])
                from_first = rows - rows[0]
                shift = from_first.mean(axis=0)
                part = len(rows), rows[0] + shift, ((from_first - shift) ** 2).sum(axis=0)
                parts = [_merged(parts[0], part) if parts else part]
        for n, mean, squares in parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                 pa.array([squares.tolist()], pa.list_(pa.float64()))], ["n", "mean", "squares"])

    return build


def bounded_clusters(described: DataFrame, most: int) -> DataFrame:
    """Add ``part``: clusters with more than ``most`` customers are halved until none has more.

    A part is cut at the middle customer by its feature of greatest variance, so
    the sizes of the halves differ by one at most. A part ``p`` has the halves
    ``2p`` and ``2p + 1``; an uncut cluster is part 1. Runs a few Spark jobs for
    each halving when called.
    """
    if most < 1:
        raise ValueError(f"a cluster needs room for one customer, not {most}")
    part = ["cluster", "part"]
    folder, number = shared_folder(described.sparkSession), 0
    open_ = stage(described.withColumn("part", F.lit(1).cast("bigint")), f"{folder}/parts-0")
    done = []
    while True:
        sizes = open_.groupBy(*part).agg(F.count("*").alias("_n"))
        done.append(even_join(open_, sizes.filter(F.col("_n") <= most), part, "left_semi"))
        large = sizes.filter(F.col("_n") > most)
        if large.isEmpty():
            break
        cut = even_join(open_, large, part, "inner")
        spread = cut.select(*part, F.posexplode("features").alias("_axis", "_value")).groupBy(*part, "_axis").agg(
            F.var_pop("_value").alias("_spread"))
        axis = spread.groupBy(*part).agg(F.max(F.struct("_spread", (-F.col("_axis")).alias("_back"))).alias("_widest"))
        valued = even_join(cut, axis, part, "inner").withColumn(
            "_value", F.round(STEPS * F.get("features", -F.col("_widest._back"))).cast("bigint")).drop("_widest")
        placed = with_position(valued, part, "_value", "id")
        upper = (F.col("position") > F.ceil(F.col("_n") / 2)).cast("bigint")
        number += 1
        open_ = stage(placed.withColumn("part", 2 * F.col("part") + upper).select(open_.columns),
                      f"{folder}/parts-{number}")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def cluster_cost(described: DataFrame, by: list[str]) -> DataFrame:
    """``customers`` and ``cost`` of each group: squared distances from its mean, added up."""
    per_feature = described.select(*by, F.posexplode("features").alias("_axis", "_value")).groupBy(*by, "_axis").agg(
        F.count("*").alias("customers"), F.var_pop("_value").alias("_spread"))
    return per_feature.groupBy(*by).agg(
        F.max("customers").alias("customers"), F.sum(F.col("customers") * F.col("_spread")).alias("cost"))


def _lines(chance: random.Random, dimensions: int) -> list[list[float]]:
    return [[chance.gauss(0, 1) for _ in range(dimensions)] for _ in range(LINES)]


def _on_lines(described: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``cluster, id, is_control``, the features as binary ``vector``, and ``places``.

    ``places`` are whole numbers on the lines of all rounds and of the pairing
    after them. Sums go feature by feature, as a sum in the engine would.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            features = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            chance = random.Random(seed)
            lines = np.array([_lines(chance, features.shape[1]) for _ in range(rounds + 1)])
            lines = lines.reshape(-1, features.shape[1])
            on = np.zeros((len(features), len(lines)))
            for feature, weight in zip(features.T, lines.T):
                on += feature[:, None] * weight[None, :]
            ends = pa.array(np.arange(len(features) + 1) * len(lines), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([row.tobytes() for row in features.astype(FEATURE)], pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(on.ravel()))], [*KEPT, "vector", "_on"])

    rows = described.select(
        "cluster", "id", (F.col("event_control_flag") == V.CONTROL_FLAG).alias("is_control"), "features")
    kinds = T.StructType([*rows.schema.fields[:3], T.StructField("vector", T.BinaryType()),
                          T.StructField("_on", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(build, kinds).select(*KEPT, "vector", F.array(*[
        F.round(STEPS * F.col("_on")[i]).cast("bigint") for i in range(LINES * (rounds + 1))]).alias("places"))


def _offers(open_: DataFrame, number: int, shift: int) -> DataFrame:
    """Pairs of neighbours of different arms on some line of a round, at most four a customer and line."""
    on_lines = open_.select("cluster", "id", "is_control", F.explode(F.array(*[
        F.struct(F.lit(i).alias("line"), F.col("places")[LINES * (number - 1) + i].alias("value")) for i in range(LINES)
    ])).alias("_on")).select("cluster", "id", "is_control", "_on.*")
    placed = with_position(on_lines, ["cluster", "line"], "value", "id")
    # Customers that a border of blocks keeps apart meet in the next round, when borders are elsewhere.
    blocks = placed.withColumn("_block", F.floor((F.col("position") + shift) / BLOCK))
    block = Window.partitionBy("cluster", "line", "_block")
    near = []
    for order in (F.col("position"), F.desc("position")):
        before = block.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        test = F.last(F.when(~F.col("is_control"), F.col("id")), ignorenulls=True).over(before)
        control = F.last(F.when(F.col("is_control"), F.col("id")), ignorenulls=True).over(before)
        near.append(F.when(F.col("is_control"), test).otherwise(control))
    other = blocks.select("cluster", "id", "is_control", F.array(*near).alias("_near")).withColumn(
        "_other", F.explode("_near")).filter("_other is not null")
    return other.select(
        "cluster", F.when(F.col("is_control"), F.col("_other")).otherwise(F.col("id")).alias("test_id"),
        F.when(F.col("is_control"), F.col("id")).otherwise(F.col("_other")).alias("control_id")).distinct()


def _with_distance(pairs: DataFrame, customers: DataFrame) -> DataFrame:
    in_control = F.coalesce("is_control", F.lit(False))
    for arm, of_arm in (("test", ~in_control), ("control", in_control)):
        theirs = customers.filter(of_arm).select(
            "cluster", F.col("id").alias(f"{arm}_id"), F.col("vector").alias(f"_{arm}"))
        pairs = even_join(pairs, theirs, ["cluster", f"{arm}_id"], "inner")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            test, control = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), FEATURE).reshape(batch.num_rows, -1)
                for name in ("_test", "_control"))
            total = np.zeros(batch.num_rows)
            for apart in np.ascontiguousarray((test - control).T):
                total += apart * apart
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(np.sqrt(total))], [*names, "distance"])

    names = [name for name in pairs.columns if name not in ("_test", "_control")]
    kinds = T.StructType([*pairs.select(*names).schema.fields, T.StructField("distance", T.DoubleType())])
    return pairs.mapInArrow(build, kinds)


def _mutual(offers: DataFrame) -> DataFrame:
    """Offers that are the best one of both sides.

    All offers have one common order, equal distances by a hash of the pair, so
    the first of them is always mutual and a tie of many does not pick one customer.
    An offer stands once for each side, and is mutual if it is the best of two.
    """
    order = F.struct("distance", F.xxhash64("test_id", "control_id").alias("tie"), "test_id", "control_id")
    sides = F.array(*[
        F.struct(F.lit(arm).alias("arm"), F.col(f"{arm}_id").alias("id")) for arm in ("test", "control")])
    best = offers.select("cluster", order.alias("_offer"), F.explode(sides).alias("_side")).groupBy(
        "cluster", "_side.arm", "_side.id").agg(F.min("_offer").alias("_best"))
    return best.select("cluster", "_best.*").groupBy("cluster", "test_id", "control_id").agg(
        F.min("distance").alias("distance"), F.count("*").alias("_sides")).filter("_sides = 2").select(
            "cluster", "distance", "test_id", "control_id")


def feature_match(described: DataFrame, rounds: int = 8, seed: int = 1) -> DataFrame:
    """One-to-one pairs of like customers: ``cluster, test_id, control_id, distance, round``.

    ``described`` comes from :func:`with_features`; distances are Euclidean over
    its features. Every customer of a cluster's smaller arm gets a partner: who
    has none after ``rounds`` rounds is paired by place on one line (``round``
    0). A cluster with one arm has no pairs. Runs Spark jobs for each round when
    called; rounds end early when one makes no pair.
    """
    spark = described.sparkSession
    folder = shared_folder(spark)
    customers = stage(_on_lines(described, rounds, seed), f"{folder}/customers")
    open_, made, drawn = customers, [], 0
    for number in range(1, rounds + 1):
        drawn = number
        offers = _offers(open_, number, number % 2 * BLOCK // 2)
        pairs = stage(_mutual(_with_distance(offers, open_)), f"{folder}/pairs-{number}")
        if pairs.isEmpty():
            break
        made.append(pairs.withColumn("round", F.lit(number)))
        used = pairs.select("cluster", F.explode(F.array("test_id", "control_id")).alias("id"))
        open_ = stage(even_join(open_, used, ["cluster", "id"], "left_anti"), f"{folder}/open-{number}")
    rest = open_.select(
        "cluster", "id", F.when(F.col("is_control"), V.CONTROL_FLAG).otherwise("N").alias("event_control_flag"),
        F.col("places")[LINES * drawn].alias("score"))
    by_place = one_to_one_match(rest).select("cluster", "test_id", "control_id")
    result = _with_distance(by_place, open_).withColumn("round", F.lit(0))
    for pairs in made:
        result = result.unionByName(pairs)
    return result
