"""Exact Jaccard join of shingle sets: size-aware, heavy and light sets apart.

Two sets of sizes a <= b can only be similar if they differ in at most
``(a + b) * (100 - percent) / (100 + percent)`` shingles.

Light sets, those up to a size boundary, enumerate all subsets of the sizes that
a similar set must share with them. Heavy sets deal their shingles by hash into
more parts than two similar sets have differences, so a similar pair agrees on
some whole part; each part names an inverted list, and the lists are scanned.
The boundary is the size up to which subsets cost less than lists. It only moves
sets between two exact ways.

Long lists are not paired up. The largest set of each list is its leader and is
compared with every other. Sets similar to their leader are settled. For the
rest, let D be the differences of a set from the leader: two sets of one list
differ by |D1| + |D2| - 2 |D1 & D2|, and as one of them is too far from the
leader, a similar pair must share a certain number of differences. That is a
join of small sets again, found through the first few of their differences,
those that the fewest sets of the leader have first: hardly any two share these.
Sets that are connected already need no further link, and lists of differences
are led before their sets are paired. Most differences are those of one set: its
lists are left out once, before any round. So is a set in a list whose place there
already shows that it differs too much from all others of the list. Sketches tell
most pairs apart before their differences are read. No two similar sets stay
unconnected.
"""

from __future__ import annotations

import math
import os
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import discard, staged

WIDTH, PERCENT = 3, 90
#: Members of a leader that are compared in one block.
BLOCK = 512
#: Differences of a block that are counted for the profile of its leader.
PROFILED = 2_000_000
#: Bits of the sketch of a set of differences.
SKETCH_BITS = 1024
CLASS_GROWTH = 1.3
#: Rows that the subsets of a light set may have for each list it would have as a heavy one.
MOST_ROWS = 12
U = np.uint64


def check_hash_seed() -> None:
    """Words are hashed by Python, with the one seed that Spark gives to all its workers."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        raise RuntimeError("the Python workers need a common PYTHONHASHSEED")


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = values + U(int(seed) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text.

    Fewer words than ``width`` make one shingle; no words make none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U)
    ids = np.fromiter(map(hash, words), np.int64, n).view(U)
    size = max(1, n - width + 1)
    out = np.full(size, min(n, width), U)
    for i in range(min(n, width)):
        out = out * U(0xC2B2AE3D27D4EB4F) + ids[i:i + size]
    return np.unique(mixed(out, 1))


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(mixed(values, seed).sum(dtype=U).astype(np.int64)) for seed in (11, 12))


@dataclass
class Scheme:
    """Which signatures a set has, given its size. ``n_docs`` only moves the boundary."""

    percent: int
    n_docs: int
    boundary: int = field(init=False)
    uppers: list[int] = field(init=False)

    def __post_init__(self):
        self.boundary = 0
        while self.boundary < 64 and self._light_pays(self.boundary + 1):
            self.boundary += 1
        self.uppers = [self.boundary]

    def differences(self, total: int) -> int:
        """Most shingles in which two similar sets of ``total`` shingles together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def shared(self, a: int, b: int) -> int:
        """Least number of shingles that similar sets of these sizes share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets a light set enumerates; pairs of equal sets need none."""
        sizes = set()
        for other in range(-(-n * self.percent // 100), min(boundary, n * 100 // self.percent) + 1):
            if self.differences(n + other) and 0 < self.shared(n, other) <= min(n, other):
                sizes.add(self.shared(n, other))
        return sorted(sizes)

    def _light_pays(self, n: int) -> bool:
        """Subsets may cost what lists cost with the sets met there, but every subset
        is a row to be written: at most ``MOST_ROWS`` times as many as lists."""
        parts, _ = self.parts(int(n * CLASS_GROWTH) + 1, n)
        return self._light_cost(n) <= min(self._heavy_cost(n), MOST_ROWS * parts)

    def _light_cost(self, n: int) -> float:
        return sum(math.comb(n, c) for c in self.subset_sizes(n, 1 << 30)) or 0

    def _heavy_cost(self, n: int) -> float:
        """Lists of a set, and the sets that meet it only because both have empty parts."""
        parts, spare = self.parts(int(n * CLASS_GROWTH) + 1, n)
        empty = parts * (1 - 1 / parts) ** n
        beyond = empty ** (spare + 1) / math.factorial(min(spare + 1, 100))
        return parts * (1 + self.n_docs * min(1.0, beyond))

    def parts(self, upper: int, lower: int) -> tuple[int, int]:
        """Parts for sets up to ``upper``, and how many of them may be empty without harm."""
        least = self.differences(2 * upper) + 1
        spare = 1
        for _ in range(8):
            parts = least + spare
            empty = parts * (1 - 1 / parts) ** lower
            spare = max(1, min(least, math.ceil(empty + 3 * math.sqrt(empty))))
        return least + spare, spare

    def classes(self, n: int) -> list[int]:
        """Upper bounds of the size classes in which a larger or equal similar set can be."""
        while self.uppers[-1] < n * 100 // self.percent:
            self.uppers.append(int(self.uppers[-1] * CLASS_GROWTH) + 1)
        lower = np.array(self.uppers[:-1])
        upper = np.array(self.uppers[1:])
        return [i + 1 for i in np.flatnonzero((upper >= n) & (lower < n * 100 // self.percent))]

    def signatures(self, values: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(class, need, signatures) of a sorted set, for every class it takes part in.

        Two similar, different sets share signatures of the class of the larger
        one. Of all parts at least spare + 1 agree, and no more of these are
        empty than a set has empty parts; so it shares at least ``need`` signatures.
        """
        n = len(values)
        out: list[tuple[int, int, np.ndarray]] = []
        scrambled = mixed(values, 21)
        if 0 < n <= self.boundary:
            total = scrambled.sum(dtype=U)
            for size in self.subset_sizes(n, self.boundary):
                gone = np.array(list(combinations(range(n), n - size)), np.int64)
                left = total - scrambled[gone].sum(axis=1, dtype=U) if n > size else np.array([total])
                out.append((-size, 1, mixed(left, 31 + size)))
        for i in self.classes(n) if n else []:
            lower, upper = self.uppers[i - 1], self.uppers[i]
            parts, spare = self.parts_of(i, lower, upper)
            place = ((values >> U(32)) * U(parts)) >> U(32)
            cuts = np.searchsorted(place, np.arange(parts, dtype=U))
            sums = np.add.reduceat(np.append(scrambled, U(0)), cuts)
            full = np.diff(np.append(cuts, n)) > 0
            sums[~full] = 0
            signed = mixed(sums ^ mixed(np.arange(parts, dtype=U), 1000 + i), 22)
            empty = parts - int(full.sum())
            # Where too many parts are empty, the empty ones have lists too.
            out.append((i, spare + 1 - empty, signed[full]) if empty <= spare else (i, 1, signed))
        return out

    def parts_of(self, i: int, lower: int, upper: int) -> tuple[int, int]:
        memo = self.__dict__.setdefault("_parts", {})
        if i not in memo:
            memo[i] = self.parts(upper, max(1, -(-lower * self.percent // 100)))
        return memo[i]


#: Rows taken from an Arrow batch at a time, so that few texts are Python objects at once.
TAKEN = 256
#: More than the parts of any class.
TAG = 1 << 16
LONGS = pa.list_(pa.int64())
GROUPS = pa.list_(pa.struct([("class", pa.int32()), ("need", pa.int32()), ("signatures", LONGS)]))
ARROW_SETS = pa.schema([*((name, pa.int64()) for name in ("doc_id", "n", "h1", "h2")), ("groups", GROUPS)])
ARROW_STARS = pa.schema([
    *((name, pa.int64()) for name in ("leader", "member", "leader_n", "member_n")),
    ("linked", pa.bool_()), ("differences", LONGS), ("sketch", LONGS)])


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TAKEN):
            yield batch.slice(start, TAKEN).to_pydict()


SET_SCHEMA = (
    "doc_id bigint, n bigint, h1 bigint, h2 bigint, "
    "groups array<struct<class: int, need: int, signatures: array<bigint>>>")


def sets_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, h1, h2, groups`` of every document, staged.

    A task gives the signatures of equal sets once, so a text with copies in a
    third of all rows has no more rows in its lists than there are tasks. Rows
    without ``doc_id`` have none: they cannot be named in a pair.
    """
    scheme = Scheme(percent, docs.count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_hash_seed()
        seen: set[tuple[int, int]] = set()
        for rows in pieces_of(batches):
            out: dict[str, list] = {name: [] for name in ARROW_SETS.names}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                values = shingles(text, width)
                key = digest(values)
                known = key in seen or doc is None
                if not known:
                    seen.add(key)
                groups = [] if known else [
                    {"class": c, "need": need, "signatures": signed.view(np.int64)}
                    for c, need, signed in scheme.signatures(values)]
                for name, value in zip(out, (doc, len(values), *key, groups), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, ARROW_SETS)

    return staged(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(build, SET_SCHEMA), "sets")


def led_pairs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leader, member`` (documents) for every list, the largest set leading; the table below.

    A member that is in fewer lists with others than it needs has no similar set
    in that class and leaves it. So texts that share a passage, which agree on a
    few parts, are never compared.

    Rows are dealt by ranges of (list, size, document), so a long list is spread
    over tasks. A task that does not see the head of a list leads its rows by
    the first of them; those leaders are replaced afterwards by the true one.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each set of a list; lists of one set leave, but at the ends of the task."""
        first_list = None
        last = (0, 0, 0, 0, False)  # list, size, document and tag of its leader; just begun
        names = ["signature", "minus_n", "leader", "tag"]
        for batch in batches:
            if not len(batch):
                continue
            lists, sizes, docs, tags = (
                batch[c].to_numpy() for c in ("signature", "minus_n", "doc_id", "tag"))
            starts = np.append(True, lists[1:] != lists[:-1])
            first = first_list is None
            if first:
                first_list = lists[0]
            else:
                starts[0] = lists[0] != last[0]
            at = np.maximum.accumulate(np.where(starts, np.arange(len(lists)), -1))
            led = [np.where(at >= 0, own[at], old) for own, old in zip((lists, sizes, docs, tags), last, strict=False)]
            # The second row of a list shows that its leader is not alone.
            second = ~starts & np.append(last[4], starts[:-1])
            member = ~starts
            member[0] |= first
            frame = pd.DataFrame(dict(zip(names, led, strict=True)))
            rows = pd.concat([
                frame[member].assign(member=docs[member], tag=tags[member]),
                frame[second].assign(member=led[2][second])])
            if len(rows):
                # The first list of a task may go on from the task before.
                yield rows.assign(open=rows["signature"] == first_list)
            last = (*(column[-1] for column in led), bool(starts[-1]))
        if first_list is not None:
            # So may its last list go on in the next.
            head = pd.DataFrame([last[:4]], columns=names)
            yield head.assign(member=last[2], open=True)

    grouped = sets.select("doc_id", (-F.col("n")).alias("minus_n"), F.explode("groups").alias("group"))
    # Class and need in one number.
    tag = (F.col("group.class") * TAG + F.col("group.need")).cast("bigint").alias("tag")
    rows = grouped.select("doc_id", "minus_n", tag, F.explode("group.signatures").alias("signature"))
    order = ["signature", "minus_n", "doc_id"]
    found = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        scan, "signature bigint, minus_n bigint, leader bigint, tag bigint, member bigint, open boolean"), "led")
    heads = found.where("open").groupBy("signature").agg(F.min(F.struct("minus_n", "leader")).alias("head"))
    # The ends of tasks may count twice, which only keeps a set that could leave.
    lists = found.groupBy("member", "tag").agg(F.count("*").alias("lists"))
    fit = lists.where(F.col("lists") >= F.pmod(F.col("tag"), F.lit(TAG))).select("member", "tag")
    fitting = even_join(found, fit, ["member", "tag"], "left_semi")
    closed = fitting.where(~F.col("open")).select("leader", "member")
    led = even_join(fitting.where("open"), heads, ["signature"], "inner").select(
        F.col("head.leader").alias("leader"), "member")
    return closed.unionByName(led).where("leader <> member").distinct(), found


def represented(sets: DataFrame) -> DataFrame:
    """``n, h1, h2, rep``: the smallest document of each set."""
    return sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))


def star_pairs(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``leader, member`` as representatives of different sets."""
    names = sets.where(F.size("groups") > 0).join(classes, ["n", "h1", "h2"]).select("doc_id", "rep", "n")
    pairs, below = led_pairs(sets)
    for side in ("leader", "member"):
        pairs = pairs.join(names.select(F.col("doc_id").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    stars = staged(pairs.select(F.col("leader_rep").alias("leader"), F.col("member_rep").alias("member"))
                   .where("leader <> member").distinct(), "stars")
    discard(sets.sparkSession, below)
    return stars


STAR_SCHEMA = (
    "leader bigint, member bigint, leader_n bigint, member_n bigint, linked boolean, "
    "differences array<bigint>, sketch array<bigint>")


def sketch_of(values: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of the values falls on it.

    Where the sketches of two sets differ, the sets differ in at least one value
    of that bit: never in fewer values than their sketches in bits.
    """
    counts = np.bincount((values.view(U) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def linked_sizes(n1, n2, apart, percent: int):
    """Whether sets that differ in ``apart`` shingles are similar; numbers or columns."""
    return 100 * (n1 + n2 - apart) >= percent * (n1 + n2 + apart)


def profile_row(leader: int, counted: list[np.ndarray]) -> tuple:
    """The differences that at least two members and one in 64 of them have, the rarest first."""
    elements, times = np.unique(np.concatenate(counted), return_counts=True)
    often = times >= max(2, len(counted) / 64)
    return leader, None, 0, 0, False, elements[often][np.argsort(times[often], kind="stable")], []


def compared(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Compare every member with its leader on the whole texts.

    A leader with many members is sent to several blocks. Each pair gets its
    differences. The first block of a leader adds its profile, a row without
    member: the differences that several of its members have, the rarest first.
    A profile only orders differences; so members beyond ``PROFILED`` differences
    need not be counted in it.
    """
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = even_join(pairs, blocks, ["leader"], "inner").select(
        F.col("member").alias("doc_id"), "leader", F.lit(1).alias("kind"),
        F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    heads = blocks.select(
        F.col("leader").alias("doc_id"), "leader", F.lit(0).alias("kind"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = dealt.unionByName(heads).join(
        classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), "doc_id")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").repartition(
        "leader", "block").sortWithinPartitions("leader", "block", "kind", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_hash_seed()
        head, head_set, counted = None, None, []
        columns = ("doc_id", "text", "leader", "kind", "block", "h1", "h2")
        for rows in pieces_of(batches):
            out: dict[str, list] = {name: [] for name in ARROW_STARS.names}
            for doc, text, leader, kind, block, h1, h2 in zip(*(rows[c] for c in columns), strict=True):
                values = shingles(text, width)
                if digest(values) != (h1, h2):
                    continue  # another row with the same doc_id
                if kind == 0:
                    if counted:
                        add(out, profile_row(head[0], counted))
                    head, head_set, counted, room = (leader, block), values, [], PROFILED
                    continue
                if head != (leader, block):
                    raise RuntimeError("a block has no leader")
                more = np.setdiff1d(values, head_set, assume_unique=True)
                less = np.setdiff1d(head_set, values, assume_unique=True)
                linked = linked_sizes(len(head_set), len(values), len(more) + len(less), percent)
                apart = np.concatenate([more, less]).view(np.int64)
                add(out, (leader, doc, len(head_set), len(values), linked, apart, sketch_of(apart)))
                if block == 0 and len(apart) <= room:
                    counted.append(apart)
                    room -= len(apart)
            yield pa.RecordBatch.from_pydict(out, ARROW_STARS)
        if counted:
            out = {name: [] for name in ARROW_STARS.names}
            add(out, profile_row(head[0], counted))
            yield pa.RecordBatch.from_pydict(out, ARROW_STARS)

    def add(out: dict[str, list], row: tuple) -> None:
        for name, value in zip(out, row, strict=True):
            out[name].append(value)

    return staged(texts.mapInArrow(compare, STAR_SCHEMA), "compared")


def rarest_first(met: DataFrame) -> DataFrame:
    """The members with their differences in the order of the profile of their leader.

    What the leader alone has changed is a difference of all its members, and
    what a member alone has changed is one of no other. In this order the few
    first differences, which decide what is paired, hardly ever agree.
    """
    profiles = met.where("member is null").select("leader", F.col("differences").alias("profile"))
    joined = even_join(met.where("member is not null"), profiles, ["leader"], "left")
    profile = F.coalesce("profile", F.array().cast("array<bigint>"))
    ordered = F.concat(F.array_except("differences", profile), F.array_intersect(profile, "differences"))
    return staged(joined.withColumn("differences", ordered).drop("profile"), "stars")


def postings(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """A row for each (leader, difference) under which a set has to be looked for.

    Prefix filter on the differences: a pair of sets that shares at least s of
    them shares one among the first |D| - s + 1 of either, at places after which
    s are still possible. ``far`` rows belong to sets that are not similar to
    their leader; every pair that is looked for has one of those. ``component``
    is what the links found so far connect. ``reach`` is the most differences
    that a similar set can have whose first shared difference is this one: no
    more than d - place are shared then.
    """
    d = F.size("differences")
    most = within(F.col("member_n") + F.least("leader_n", F.floor(F.col("member_n") * 100 / percent)), percent)
    least_far, half = F.greatest(F.lit(1), d - most), F.ceil((d + 1) / 2)
    # A far set meets far ones from its longer prefix on, and linked ones of their shorter prefix.
    rows = even_join(stars, labels.withColumnRenamed("rep", "member"), ["member"]).select(
        "leader", "member", "member_n", (~F.col("linked")).alias("far"), d.alias("d"), "differences",
        F.coalesce("component", "member").alias("component"), least_far.alias("least_far"),
        F.when(F.col("linked"), half).otherwise(F.greatest(half, least_far)).alias("least_near"),
        (d + most).alias("reach_of_first"))
    share = F.when(F.col("far"), F.least("least_far", "least_near")).otherwise(F.col("least_near"))
    cut = rows.select("*", F.posexplode(
        F.slice("differences", F.lit(1), (F.col("d") - share + 1).cast("int"))).alias("place", "element"))
    return cut.select(
        "leader", "element", "member", "member_n", "far", "d", "place", "component",
        (F.col("far") & (F.col("place") <= F.col("d") - F.col("least_far"))).alias("asks"),
        (F.col("place") <= F.col("d") - F.col("least_near")).alias("answers"),
        (F.col("reach_of_first") - 2 * F.col("place")).alias("reach"))


def within(total: Column, percent: int) -> Column:
    """Most differences of two similar sets that have ``total`` shingles together."""
    return F.floor(total * (100 - percent) / (100 + percent))


def with_partner(rows: list[tuple]) -> list[bool]:
    """Which (d, reach, component, asks, answers) rows of one list have another there to be paired with.

    Of two rows one asks and one answers, their components differ, and neither
    has more differences than the other reaches. For each row the rows within its
    reach are the first by d; of these only the two components that reach furthest matter.
    """
    has = [False] * len(rows)
    by_d = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for role, other in ((3, 4), (4, 3)):
        sizes, furthest = [], []
        most, owner, next_most = -1, None, -1
        for i in by_d:
            d, reach, component = rows[i][:3]
            if not rows[i][other]:
                continue
            if component == owner:
                most = max(most, reach)
            elif reach > most:
                most, owner, next_most = reach, component, most
            else:
                next_most = max(next_most, reach)
            sizes.append(d)
            furthest.append((most, owner, next_most))
        for i, row in enumerate(rows):
            within_reach = bisect_right(sizes, row[1]) if row[role] else 0
            if within_reach:
                most, owner, next_most = furthest[within_reach - 1]
                has[i] |= (next_most if owner == row[2] else most) >= row[0]
    return has


def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole lists that have a partner; all of the first and the last list."""
    held, last, first = [], None, True
    for batch in batches:
        leaders, elements = (batch.column(c).to_numpy() for c in ("leader", "element"))
        changes = (leaders[1:] != leaders[:-1]) | (elements[1:] != elements[:-1])
        begins = np.flatnonzero(np.append(last not in (None, (leaders[0], elements[0])), changes))
        last = leaders[-1], elements[-1]
        if len(begins):
            rows = pa.Table.from_batches([*held, batch.slice(0, begins[-1])], batch.schema)
            columns = [rows[c].to_pylist() for c in ("d", "reach", "component", "asks", "answers")]
            ends = begins + (rows.num_rows - begins[-1])
            stays: list[bool] = []
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                stays += [True] * (end - start) if first else with_partner(
                    list(zip(*(column[start:end] for column in columns), strict=True)))
                first = False
            yield from rows.filter(pa.array(stays, pa.bool_())).to_batches()
            held, batch = [], batch.slice(begins[-1])
        if first:
            yield batch
        else:
            held.append(batch)
    yield from held


def in_company(posts: DataFrame, pairable: bool = False) -> DataFrame:
    """The rows of lists with at least two sets, staged. ``x`` is the latest head, none yet.

    Rows are dealt by ranges, so a long list is spread over tasks. The two ends
    of a task stay: their lists may go on in another. With ``pairable`` a row
    also leaves a list in which no other can be similar to it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stays_anyway = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            leaders, elements = (rows[c].to_numpy() for c in ("leader", "element"))
            same = (leaders[1:] == leaders[:-1]) & (elements[1:] == elements[:-1])
            stays = np.append(stays_anyway, same) | np.append(same, False)
            held, stays_anyway = rows.slice(rows.num_rows - 1), bool(stays[-1])
            yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(stays[:-1])).to_batches()
        if held is not None:
            yield from held.to_batches()

    order = ["leader", "element", "member"]
    dealt = posts.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = dealt.mapInArrow((lambda batches: partnered(scan(batches))) if pairable else scan, dealt.schema)
    return staged(kept.withColumn("x", F.lit(None).cast("bigint")), "posts")


def live_lists(posts: DataFrame) -> DataFrame:
    """The lists that hold a far set and several components, staged.

    Each has its first far set as ``x``, and ``fresh`` where that was not its head before.
    """
    key = ["leader", "element"]
    heads = posts.groupBy(*key).agg(
        F.min(F.when(F.col("far"), F.struct("component", "member"))).alias("head"),
        F.min("component").alias("first"), F.max("component").alias("last"), F.min("x").alias("earlier"),
    ).where("head is not null and first <> last").select(
        *key, F.col("head.component").alias("head_component"), F.col("head.member").alias("x"),
        (~F.col("head.member").eqNullSafe(F.col("earlier"))).alias("fresh"))
    return staged(even_join(posts.drop("x", "head_component", "fresh"), heads, key, "inner"), "posts")


def pairs_with_heads(lists: DataFrame) -> DataFrame:
    """``leader, x, y``: the new head of each live list with the list's sets of other components."""
    return lists.where("fresh and component <> head_component").select(
        "leader", "x", F.col("member").alias("y")).distinct()


def pairs_across(posts: DataFrame, percent: int) -> DataFrame:
    """``leader, x, y``: what is left, pairs of a far set and one of another component in a list."""
    names = ("member", "member_n", "far", "d", "place", "component")
    side = lambda tag, role: posts.where(role).select(
        "leader", "element", *[F.col(c).alias(f"{tag}_{c}") for c in names])
    total = F.col("x_member_n") + F.col("y_member_n")
    need = F.ceil((F.col("x_d") + F.col("y_d") - within(total, percent)) / 2)
    possible = F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place"))
    one, two = side("x", "asks"), side("y", "answers")
    on = (
        (one["leader"] == two["leader"]) & (one["element"] == two["element"])
        & (F.col("x_component") != F.col("y_component"))
        & (~F.col("y_far") | (F.col("x_member") < F.col("y_member")))
        & (100 * F.least("x_member_n", "y_member_n") >= percent * F.greatest("x_member_n", "y_member_n"))
        & (possible >= need))
    return one.join(two, on).select(
        one["leader"], F.col("x_member").alias("x"), F.col("y_member").alias("y")).distinct()


def similar(pairs: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``leader, member``: those of the pairs that are similar, by their differences from one leader.

    Pairs whose sketches already differ in too many bits are left out first, so
    only the differences of the others are moved.
    """
    def side(name: str, what: str) -> DataFrame:
        return stars.select(
            "leader", F.col("member").alias(name), F.col("member_n").alias(f"{name}_n"),
            F.col(what).alias(f"{name}_{what}"))

    sketched = pairs.join(side("x", "sketch"), ["leader", "x"]).join(side("y", "sketch"), ["leader", "y"])
    unlike = F.aggregate(
        F.zip_with("x_sketch", "y_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    possible = staged(sketched.where(linked_sizes(F.col("x_n"), F.col("y_n"), unlike, percent)).select(
        "leader", "x", "y"), "pairs")
    wanted = possible.select("leader", F.explode(F.array("x", "y")).alias("member")).distinct()
    stars = staged(stars.select("leader", "member", "member_n", "differences").join(
        wanted, ["leader", "member"], "left_semi"), "wanted")
    both = possible.join(side("x", "differences"), ["leader", "x"]).join(side("y", "differences"), ["leader", "y"])
    shared = F.size(F.array_intersect("x_differences", "y_differences"))
    apart = F.size("x_differences") + F.size("y_differences") - 2 * shared
    return both.where(linked_sizes(F.col("x_n"), F.col("y_n"), apart, percent)).select(
        F.col("x").alias("leader"), F.col("y").alias("member"))


#: Rounds in which a list is led by its first far set before what is left is paired.
HEAD_ROUNDS = 3


def relabelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with the components that the links now connect."""
    joined = even_join(posts.drop("component"), labels.withColumnRenamed("rep", "member"), ["member"], "left")
    return joined.withColumn("component", F.coalesce("component", "member"))


def connected(stars: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect all similar sets, and the component of each linked set.

    Links to the leaders come first. After that a set matters to another only if
    no link connects them yet, so the rows of a group of near copies fall out as
    soon as their group holds together. Lists of differences are led like the
    lists before: their first far set is compared with the sets of other
    components, unless it was in the round before. Only what several such rounds
    leave apart is paired.
    """
    spark = stars.sparkSession
    links = staged(stars.where("linked").select("leader", "member").distinct(), "links")
    labels = components(links)
    posts = in_company(postings(stars, labels, percent), pairable=True)

    def joined_by(pairs: DataFrame) -> bool:
        nonlocal links, labels
        found = staged(similar(pairs, stars, percent).distinct(), "links")
        if found.isEmpty():
            return False
        links = staged(links.unionByName(found).distinct(), "links")
        labels = components(links)
        return True

    for _ in range(HEAD_ROUNDS):
        lists = live_lists(posts)
        discard(spark, posts)
        posts = lists
        if not joined_by(pairs_with_heads(posts)):
            break
        lists = staged(relabelled(posts, labels), "posts")
        discard(spark, posts)
        posts = lists
    joined_by(pairs_across(posts, percent))
    return links, labels


def components(links: DataFrame) -> DataFrame:
    """``rep, component``: the smallest node that links reach, for nodes with links.

    Each round takes the smallest label among neighbours and then the label of
    the label, so chains shorten as powers of two. Every round is staged.
    """
    pairs = links.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    edges = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = even_join(edges, labels.select(F.col("a").alias("b"), "label"), ["b"], "inner").groupBy("a").agg(
            F.min("label").alias("near"))
        nearer = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("further"))
        moved = staged(even_join(nearer, jump, ["next"], "left").select(
            "a", F.least("next", F.coalesce("further", "next")).alias("label"),
            F.col("label").alias("old")), "labels")
        done = moved.where("label <> old").isEmpty()
        labels = moved.select("a", "label")
        if done:
            return labels.select(F.col("a").alias("rep"), F.col("label").alias("component"))


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_connecting_links`` for every row.

    ``n_connecting_links`` counts the verified links of the row's set that were
    needed to connect its class, not all its similar sets. A row without words has no shingles and stands alone. Rows
    without ``doc_id`` join the class of their equal set if it has a named row,
    else their component is null. Repeated rows are members of one class.
    """
    docs = docs.select("doc_id", "text")
    sets = sets_of(docs, width, percent)
    classes = staged(represented(sets), "classes")
    pairs = star_pairs(sets, classes)
    # From here on the signatures are not needed.
    narrow = staged(sets.select("doc_id", "n", "h1", "h2"), "narrow")
    discard(sets.sparkSession, sets)
    met = compared(docs, pairs, classes, width, percent)
    stars = rarest_first(met)
    discard(docs.sparkSession, met)
    links, labels = connected(stars, percent)
    discard(docs.sparkSession, stars)
    ends = links.select(F.explode(F.array("leader", "member")).alias("rep")).groupBy("rep").agg(
        F.count("*").alias("n_connecting_links"))
    named = classes.join(labels, "rep", "left").join(ends, "rep", "left").select(
        "n", "h1", "h2", F.coalesce("component", "rep").alias("component"),
        F.coalesce("n_connecting_links", F.lit(0)).alias("n_connecting_links"))
    return even_join(narrow, named, ["n", "h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_connecting_links", F.lit(0)).cast("bigint").alias("n_connecting_links"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each class the row with the smallest ``doc_id`` stays, with all its columns.

    Rows with one ``doc_id`` stay or go together; rows without stay if no named
    row is in their class.
    """
    kept = jaccard_classes(docs, width, percent).where(
        F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    whole = docs.select(F.struct("*").alias("whole"), "doc_id")
    return whole.join(kept, whole["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select("whole.*")
