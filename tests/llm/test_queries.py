"""Registered queries: oracles, contracts' columns, and the pipeline's stages."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from recallspark.llm import queries
from recallspark.llm.similar import groups
from recallspark.sources.staging import staged
from tests.conftest import same_rows

SF = "/root/testdata/sf0.01" if "TEST_SF_DIR" not in os.environ else os.environ["TEST_SF_DIR"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_oracle(spark, duck, name):
    from tests.conftest import SF_DIR

    same_rows(queries.queries()[name](spark, SF_DIR), duck.sql(queries.ORACLE[name]))


def test_pipeline_stage_by_stage(spark):
    """All but the last stage keep the columns; each stage's decisions take effect on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.where("length(text) <> n_chars").isEmpty()
        if name == "simhash_near_dedup":
            assert groups(docs).select("component").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] == counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
