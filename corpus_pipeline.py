"""The corpus pipeline: quality rules, exact copies, near copies, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. The first three
return the columns of ``documents``; the last returns the packed pieces.
When a stage begins, its input is written, so what the stage before staged goes;
staged tables of other results stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from promolift.llm.common import discard_folders, made_by
from promolift.llm.exact_dedup import drop_copies
from promolift.llm.jaccard import drop_near_copies
from promolift.llm.packing import pack
from promolift.llm.quality import keep_good
from promolift.sources.sinks import shared_folder, stage


#: What the latest stage has staged.
_staged: list[str] = []


def _after_the_last(spark: SparkSession, step: Callable[[], DataFrame]) -> DataFrame:
    discard_folders(spark, _staged)
    _staged.clear()
    result, folders = made_by(step)
    _staged.extend(folders)
    return result


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _after_the_last(spark, lambda: keep_good(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _after_the_last(spark, lambda: drop_copies(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similar from 80 per cent on."""
    return _after_the_last(spark, lambda: drop_near_copies(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _after_the_last(spark, lambda: pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), "kept", end_id=1))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packed", packed),
]

#: Packing needs the ids of a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"{shared_folder(spark)}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
