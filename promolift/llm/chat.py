"""Reply trees formatted as conversations.

Messages form trees through ``parent_id``. Self-joins that double their reach
find, for every message, its ancestor 1, 2, 4, ... steps up and the sum of the
scores on the way, until every path has met its root. The leaves of a tree are
its branches, ranked by score. The messages of the chosen branches are found by
walking the same pointers down from the longest stride to the shortest, which
doubles the known part of each path in every join. No path is carried through
the joins, so the work is messages x log(depth), whatever the shape.

The template marks turns as ``[TURN] role [SAYS] text [/TURN]`` and what the
assistant says as ``[TURN] role [SAYS] text </s>``, each on a line of its own.
Control strings inside roles and texts get a backslash in front, also where
backslashes stand before them already; taking one off again gives back the text.
A space stands before every mark of the template, so it is never taken for an
escaped one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import before, staged

#: The strings that a text must not be able to forge.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[SAYS]", "[/TURN]"]
CONTROL = "|".join(re.escape(c) for c in CONTROLS)
LOSS_ROLE = "assistant"
NODE = ["conv_id", "msg_id"]


def escaped(text: Column) -> Column:
    pattern = "(" + "|".join(r"\Q" + c + r"\E" for c in CONTROLS) + ")"
    return F.regexp_replace(F.coalesce(text, F.lit("")), pattern, r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(" + CONTROL + ")", r"\1", text)


def ancestors(messages: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The messages as trees, depth and path score of each, and the pointers of each stride.

    A parent that does not exist counts as none. Parents that form a circle never
    meet a root: the smallest message of the circle, the only one that is the
    least of its own ancestors, loses its parent, and the paths are found anew.
    """
    parents = messages.select(F.col("conv_id"), F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    base = messages.select(*NODE, "parent_id", "score").join(parents, ["conv_id", "parent_id"], "left")
    reach = staged(base.select(
        *NODE, F.when(F.col("known"), F.col("parent_id")).alias("up"),
        F.col("parent_id").alias("least"), F.lit(1).cast("bigint").alias("length"),
        F.coalesce("score", F.lit(0.0)).alias("total")), "stride")
    done, open_ = [reach.where(F.col("up").isNull())], reach.where(F.col("up").isNotNull())
    strides = []
    most = max(1, messages.count()).bit_length()
    # Only paths that have not met their root are joined again.
    while not open_.isEmpty():
        if len(strides) > most:
            cut = open_.where("least = msg_id").select(*NODE, F.lit(True).alias("cut"))
            return ancestors(staged(messages.join(cut, NODE, "left").withColumn(
                "parent_id", F.when(F.col("cut").isNull(), F.col("parent_id"))).drop("cut"), "messages"))
        strides.append(open_.select(*NODE, "up"))
        above = reduce(DataFrame.unionByName, [*done, open_]).select(
            "conv_id", F.col("msg_id").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"),
            F.col("length").alias("more"), F.col("total").alias("gain"))
        step = staged(open_.join(above, ["conv_id", "up"]).select(
            *NODE, F.col("next").alias("up"), F.least("least", "other").alias("least"), (F.col("length") + F.col("more")).alias("length"),
            (F.col("total") + F.col("gain")).alias("total")), "stride")
        done.append(step.where(F.col("up").isNull()))
        open_ = step.where(F.col("up").isNotNull())
    return messages, reduce(DataFrame.unionByName, done).drop("up", "least"), strides


def branches(messages: DataFrame, reach: DataFrame) -> DataFrame:
    """``conv_id, leaf, branch, branch_score``: branches ranked by mean score, then leaf."""
    inner = messages.select("conv_id", F.col("parent_id").alias("msg_id")).where("msg_id is not null").distinct()
    leaves = reach.join(inner, NODE, "left_anti").withColumn("branch_score", F.col("total") / F.col("length"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), "msg_id")
    return leaves.select("conv_id", F.col("msg_id").alias("leaf"), "branch_score",
                         F.row_number().over(order).alias("branch"))


def paths(messages: DataFrame, most_branches: int | None) -> DataFrame:
    """``conv_id, leaf, branch, branch_score, depth, role, text`` for each message of a chosen path."""
    messages, reach, strides = ancestors(messages)
    chosen = branches(messages, reach)
    if most_branches is not None:
        chosen = chosen.where(F.col("branch") <= most_branches)
    found = staged(chosen.withColumn("msg_id", F.col("leaf")), "path")
    for stride in reversed(strides):
        step = found.join(stride, NODE).withColumn("msg_id", F.col("up")).drop("up")
        found = staged(found.unionByName(step), "path")
    depth = reach.select(*NODE, F.col("length").alias("depth"))
    return found.join(depth, NODE).join(messages.select(*NODE, "role", "text"), NODE)


def formatted(rows: DataFrame) -> DataFrame:
    """One row per path with ``formatted`` and the ``loss_spans`` (start, end) in its code points.

    A conversation is one text, so its turns meet in one row, and only they.
    """
    path = ["conv_id", "leaf"]
    head = F.concat(F.lit("[TURN] "), escaped(F.col("role")), F.lit(" [SAYS] "))
    mine = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    parts = rows.select(
        *path, "branch", "branch_score", "depth", mine.alias("loss"), head.alias("head"),
        escaped(F.col("text")).alias("body"),
        F.when(mine, F.lit(" </s>\n")).otherwise(F.lit(" [/TURN]\n")).alias("tail"))
    head_n, body_n, tail_n = F.length("head"), F.length("body"), F.length("tail")
    placed = parts.withColumn("n", head_n + body_n + tail_n).withColumn(
        "start", before("n", path, ["depth"]) + head_n)
    turn = F.struct(
        "depth", F.concat("head", "body", "tail").alias("line"), "loss",
        F.struct("start", (F.col("start") + body_n).alias("end")).alias("span"))
    whole = placed.groupBy(*path).agg(
        F.first("branch").alias("branch"), F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        *path, "branch", "branch_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.line"), "").alias("formatted"),
        F.filter("turns", lambda t: t["loss"])["span"].alias("loss_spans"))


def named(messages: DataFrame) -> DataFrame:
    """``messages`` with ids as structs, which are never null and equal where their nulls are.

    Messages without ``msg_id`` get a number, as nothing can reply to them. So do
    repeated ones but the first by parent, role, text and score.
    """
    nobody = F.lit(None).cast("bigint")
    numbered = staged(messages.select(
        *NODE, "parent_id", "role", "text", "score", F.monotonically_increasing_id().alias("number")), "named")
    named_rows = numbered.withColumn("name", F.struct(*NODE))
    # Names alone are counted first; what else a message holds is compared for repeated ones only.
    repeated = named_rows.where("msg_id is not null").groupBy("name").agg(
        F.count("*").alias("n")).where("n > 1").select("name")
    first = even_join(named_rows, repeated, ["name"], "inner").groupBy("name").agg(
        F.min(F.struct("parent_id", "role", "text", "score", "number"))["number"].alias("first"))
    known = even_join(named_rows, first, ["name"])
    own = F.col("msg_id").isNull() | (F.col("first") != F.col("number"))
    return staged(known.select(
        F.struct("conv_id").alias("conv_id"),
        F.struct("msg_id", F.when(own, F.col("number")).otherwise(nobody).alias("number")).alias("msg_id"),
        F.when(F.col("parent_id").isNotNull(), F.struct(
            F.col("parent_id").alias("msg_id"), nobody.alias("number"))).alias("parent_id"),
        "role", "text", "score"), "named")


def format_trees(messages: DataFrame, most_branches: int | None = None) -> DataFrame:
    """Format the paths of ``conv_id, msg_id, parent_id, role, text, score``.

    (conv_id, msg_id) names a message; those without ``conv_id`` are one
    conversation, and each without ``msg_id`` is a message of its own. Of several
    rows with one name the first by parent, role, text and score is replied to,
    the others are leaves of their own. A circle of parents is broken at its
    smallest message. Null roles and texts are empty, null scores 0. Branches of
    equal score are ranked by leaf. An empty table gives no rows, and columns
    beyond these are not read.
    """
    whole = formatted(paths(named(messages), most_branches))
    return whole.withColumns({"conv_id": F.col("conv_id.conv_id"), "leaf": F.col("leaf.msg_id")})


TURN = re.compile(
    r"\[TURN\] (?P<role>.*?) \[SAYS\] (?P<text>.*?) (?:\[/TURN\]|</s>)\n", re.S)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescaped(m["role"]), unescaped(m["text"])) for m in TURN.finditer(text)]


def digests(conversations: DataFrame) -> DataFrame:
    """Read turns and loss text back from formatted conversations and digest them."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(
                    batch["conv_id"], batch["formatted"], batch["loss_spans"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescaped(text[span["start"]:span["end"]]) for span in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((
                    conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = conversations.schema["conv_id"].dataType
    # As strings: pandas would make floats of numbers with nulls among them.
    return conversations.select(F.col("conv_id").cast("string"), "formatted", "loss_spans").mapInPandas(
        read, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint").withColumn("conv_id", F.col("conv_id").cast(kind))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees without branches: each message replies to the one before.

    Rows of one turn follow each other by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(
        "conv_id", "role", "text", F.row_number().over(order).cast("bigint").alias("msg_id"))
    return staged(numbered.withColumns({
        "parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1),
        "score": F.lit(0.0)}), "messages")
