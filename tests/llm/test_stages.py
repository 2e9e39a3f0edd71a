"""The pipeline's stages on their edge cases, one after another and by themselves."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from recallspark.sources.staging import staged
from tests.llm.corpus import frame

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"the house{k} of the old town and its people{k * 7} was here" for k in range(40))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    out = STAGES[name](spark, frame(spark, []), SF)
    assert out.count() == 0
    assert name == "packing" or out.columns == frame(spark).columns


@pytest.mark.parametrize("name", [n for n in STAGES if n not in ("packing", "language_id")])
def test_nulls_repeats_and_clashing_columns(spark, name):
    """NULL ids, texts and columns, a repeated row, ties and a very long text; `did`, `spans` and `gone` are columns."""
    other = PROSE.replace("house", "river").replace("town", "field")
    rows = [(None, None, None, None, None, 7, "x", "y"), (None, other, None, "s", 1, 7, "x", None), (2, "", "en", "s", 0, None, None, "z")]
    rows += [(3, PROSE, "en", "s", 1, 7, "x", "y")] * 2 + [(4, " ".join(f"w{k}" for k in range(60_000)), "en", "s", 1, 7, "x", "y")]
    docs = frame(spark, rows)
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["did"], r["spans"], r["gone"]) for r in out.collect())
    each = Counter((r[0], r[5], r[6], r[7]) for r in rows)
    if name == "simhash_near_dedup":
        each[3, 7, "x", "y"] = 1  # one of the repeats
        del each[None, 7, "x", "y"]  # without a word like the empty text, which has a smaller id
    assert got == each


def test_language_stage_keeps_known_rows(spark):
    """The stage judges each row by its text alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 9").selectExpr("cast(null as bigint) doc_id", *docs.columns[1:]))
    twice = twice.unionByName(docs.limit(1).selectExpr("cast(-1 as bigint) doc_id", "cast(null as string) text", *docs.columns[2:]))
    kept = Counter(r["doc_id"] for r in STAGES["language_id"](spark, twice, SF).collect())
    assert kept[-1] == 0 and kept[None] == kept[9] and all(kept[k] in (0, 2) for k in range(5)) and sum(kept.values()) > 150


def test_repeated_passages_go_and_the_rest_stays(spark):
    """The suffix stage cuts a passage of over 50 words from all that hold it and nothing else."""
    passage = " ".join(f"word{k}" for k in range(55))
    own = [" ".join(f"{c}{k * 3}{c}" for k in range(80)) for c in "abcdef"]
    rows = [(k, f"{own[k]} {passage} {own[k][::-1]}" if k < 4 else own[k], "en", "s", 1, 0, "", "") for k in range(6)]
    left = {r["doc_id"]: r["text"] for r in STAGES["suffix_array_dedup"](spark, frame(spark, rows), SF).collect()}
    assert all(passage not in left[k] and own[k] in left[k] and own[k][::-1] in left[k] for k in range(4))
    assert left[4] == own[4] and left[5] == own[5]


def test_run_leaves_only_its_result(spark):
    out = corpus_pipeline.run(spark, SF)
    paths = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    assert len(paths) == 1 and out.count() > 0
    assert staged(out.limit(1), "again").count() == 1


@pytest.mark.parametrize("given", [None, "77"])
def test_batches_are_small_unless_the_session_says_otherwise(spark, given):
    key, stage = "spark.sql.execution.arrow.maxRecordsPerBatch", dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    before = spark.conf.get(key, None)
    spark.conf.unset(key) if given is None else spark.conf.set(key, given)
    try:
        stage(spark, spark.createDataFrame([(1, "a text")], "doc_id long, text string"), None)
        assert spark.conf.get(key) == (given or str(corpus_pipeline.BATCH_ROWS))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
