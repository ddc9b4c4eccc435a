"""The corpus pipeline, stage after stage, against what each stage may keep."""

import os

import pytest

import corpus_pipeline
from evidentia.llm.common import table

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")
def test_stages(spark):
    docs = table(spark, ROOT, "documents")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stage(function(spark, docs, ROOT), "test")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(before[r["doc_id"]] == r["text"] for r in rows)
        if name == "exact dedup":
            assert sorted(r["text"] for r in rows) == sorted(set(before.values()))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
