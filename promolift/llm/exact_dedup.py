"""Exact deduplication by a tree of merged digest runs.

Every input partition becomes one run: a row per distinct digest with its
smallest identifier and number of copies. In each round ``fan_in`` neighbouring
runs meet and are merged into one, so that after log(runs) rounds a single run
is left. A digest that a third of all rows share has at most one row per run
and ``fan_in`` rows per merge, whatever its number of copies: the tree is the
salt. Two texts count as equal only if SHA-256, length and a second hash agree,
which is verified again at every level because all three are the merge key.
The winners then travel down the same tree, so no join meets a hot key either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import WHITE_CLASS, staged, whole_text

FAN_IN = 16
IDENTITY = ["sha", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(whole_text(text), WHITE_CLASS + "+", " ")


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the identity of a row's text, its run and a row number."""
    clean = normalised(F.col(text))
    return docs.select(
        *docs.columns,
        F.unhex(F.sha2(clean.cast("binary"), 256)).alias("sha"),
        F.octet_length(clean).cast("bigint").alias("n_bytes"),
        F.xxhash64(clean).alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def order_of(doc_id: str) -> Column:
    """Smallest identifier first; a row without one comes after all others."""
    return F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), F.col("row"))


def merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """One level up: ``fan_in`` neighbouring runs become one."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", *IDENTITY)
        .agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    )


def resolve(digests: DataFrame, doc_id: str = "doc_id", fan_in: int = FAN_IN) -> DataFrame:
    """Add ``first`` (missing, id, row of the row that stays) and ``copies``.

    ``digests`` is a staged :func:`with_digest` table. Empty tables give no
    rows; of repeated rows with one identifier exactly one is first.
    """
    runs = digests.groupBy("run", *IDENTITY).agg(
        F.min(order_of(doc_id)).alias("first"), F.count("*").alias("copies")
    )
    levels = [staged(runs, "run-0")]
    top = digests.agg(F.max("run")).first()[0] or 0
    while top > 0:
        levels.append(staged(merged(levels[-1], fan_in), f"run-{len(levels)}"))
        top //= fan_in
    winners = levels.pop()
    while levels:
        lower = levels.pop().select(
            F.col("run").alias("low_run"), F.floor(F.col("run") / fan_in).cast("int").alias("run"),
            *IDENTITY)
        winners = lower.join(winners, ["run", *IDENTITY]).select(
            F.col("low_run").alias("run"), *IDENTITY, "first", "copies")
    return digests.join(winners, ["run", *IDENTITY])


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts equal empty ones. A group whose identifiers are all null keeps
    one row and has a null ``keep_id``.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digests = staged(with_digest(narrow).drop("text"), "digests")
    return resolve(digests).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs`` whatever their names."""
    whole = docs.select(
        F.struct("*").alias("whole"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = staged(with_digest(whole).drop("text"), "documents")
    decided = resolve(table.drop("whole")).where(F.col("row") == F.col("first.row")).select("row")
    return table.select("whole", "row").join(decided, "row", "left_semi").select("whole.*")
