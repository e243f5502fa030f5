"""Registered queries against their SQL twins, and the pipeline against plain Python."""

from __future__ import annotations

import pytest

import corpus_pipeline
from promolift.sources.sinks import shared_folder, stage as write_stage
from promolift.llm.queries import ORACLES, QUERIES
from tests.check import connect, differences
from tests.llm.test_operators import brute_classes, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert differences([tuple(r) for r in frame.collect()], frame.columns, cursor.fetchall(), names) is None


def test_all_operators_have_a_query():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


def test_pipeline_equals_plain_steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(write_stage(stage(spark, steps[-1], FOLDER), f"{shared_folder(spark)}-{name}"))
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = [[r.doc_id for r in step.select("doc_id").collect()] for step in steps]
    good = {r.doc_id for r in QUERIES["op9_adaptive_quality"](spark, FOLDER).collect() if r.kept}
    assert sorted(ids[1]) == sorted(good)
    first: dict[str, int] = {}
    for doc in sorted(ids[1]):
        first.setdefault(normal(text[doc]), doc)
    assert sorted(ids[2]) == sorted(first.values())
    classes = brute_classes([(doc, text[doc]) for doc in ids[2]], 5, 80)
    assert sorted(ids[3]) == sorted({c for _, c in classes.values()})
    assert set(ids[4]) == set(ids[3])
    for step in steps[1:4]:
        assert step.columns == docs.columns
    pieces = steps[4].collect()
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
