"""A queue that a batch is appended to, against the loop over its operations."""

from __future__ import annotations

import random

import pytest

from recallspark.operators import relational


def appended(queue, batch):
    pending, fate = {(r, k): s for r, k, s in queue}, {}
    first = set(queue)
    for rep, kind, seq in sorted(batch, key=lambda o: o[2]):
        pending.pop((rep, "REMOVE" if kind == "ADD" else "ADD"), None)
        pending.setdefault((rep, kind), seq)
    now = {(r, k, s) for (r, k), s in pending.items()}
    fate = {(*o, "KEPT" if o in now else "DELETED") for o in first}
    return fate | {(*o, "INSERTED") for o in now - first}


@pytest.mark.parametrize("seed", range(3))
def test_appended_operations(spark, seed):
    rng = random.Random(seed)
    kinds = ["ADD", "REMOVE"]
    queue = [(rep, kind, -2 * rep - i) for rep in range(40) for i, kind in enumerate(kinds) if rng.random() < 0.4]
    batch = [(rng.randrange(60) if k % 3 else 7, rng.choice(kinds), k) for k in range(150)]
    schema = "rep_id long, kind string, seq long"
    a, b = spark.createDataFrame(queue, schema), spark.createDataFrame(batch, schema)
    got = relational.enqueued(a, b).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == appended(queue, batch)
    assert {tuple(r) for r in relational.enqueued(a, b.limit(0)).collect()} == {(*o, "KEPT") for o in queue}


def test_best_point_may_not_exist(spark):
    sweep = spark.createDataFrame([(0.0, 0.5, 10, 9), (0.1, 0.4, 8, 8), (0.1, 0.6, 8, 8)], "margin double, threshold double, accepted long, correct long")
    known = spark.createDataFrame([(20,)], "known long")
    best = relational.best_point(sweep, known, 5, 0.95, 0.1).collect()
    assert [tuple(r) for r in best] == [(0.1, 0.4, 8, 8, 1.0, 0.4)]
    assert relational.best_point(sweep, known, 5, 0.95, 0.9).isEmpty() and relational.best_point(sweep, known, 11, 0.1, 0.1).isEmpty()


def test_merit_of_a_face(spark):
    from pyspark.sql import functions as F

    from recallspark.functions import boxes

    rows = [(0.9, [0.1, 0.2, 0.4, 0.8], [[0.2, 0.3], [0.3, 0.3], [0.25, 0.4]], 1.0), (0.5, [0.0, 0.0, 0.5, 0.5], [[0.1, 0.3], [0.3, 0.3], [0.3, 0.4]], 0.5),
            (0.5, [0.0, 0.0, 0.5, 0.5], [[0.2, 0.3], [0.2, 0.3], [0.3, 0.4]], 0.1), (0.5, [0.0, 0.0, 0.5, 0.5], [[0.2, 0.3]], 1.0), (0.7, [0.5, 0.5, 0.4, 0.9], None, 1.0)]
    frame = spark.createDataFrame([r[:3] for r in rows], "score double, box array<double>, points array<array<double>>")
    box = [F.get("box", F.lit(i)) for i in range(4)]
    got = [r["m"] for r in frame.select(boxes.merit(F.col("score"), box, boxes.frontal(F.col("points"))).alias("m")).collect()]
    want = [s * (max(b[2] - b[0], 0) * max(b[3] - b[1], 0)) ** 0.5 * f for s, b, _, f in rows]
    assert got == pytest.approx(want)


def test_policies_out_of_range_are_refused():
    from recallspark.operators.retrieval import Policy

    assert Policy().automatic and not Policy(match=1.5).automatic
    for wrong in (dict(quality=1.1), dict(quality=-0.1), dict(match=2.1), dict(ceiling=0.9, match=0.5), dict(margin=0.0), dict(margin=2.1), dict(ceiling=-1.1)):
        with pytest.raises(ValueError, match="policy"):
            Policy(**wrong)


def test_a_search_needs_a_text_and_kinds(spark):
    rows = spark.createDataFrame([(1, "ann"), (2, "anna"), (3, "joanna")], "id long, name string")
    seen = spark.createDataFrame([(10 * k + i, i, k) for i in (1, 2, 3) for k in range(3)], "id long, identity_id long, time_ms long")
    whole = spark.createDataFrame([(5, 3)], "total long, processed long")
    got = relational.name_search("  ANN ", rows, rows.limit(0), rows, seen, whole, ("PERSON", "OCCURRENCE"), 2).collect()
    assert sorted((r["kind"], r["position"], r["id"]) for r in got) == [("OCCURRENCE", 1, 22), ("OCCURRENCE", 2, 21), ("PERSON", 1, 1), ("PERSON", 2, 2)]
    assert {(r["query"], r["kinds"], r["total"], r["processed"]) for r in got} == {("ann", "PERSON,OCCURRENCE", 5, 3)}
    for text, kinds in ((" ", ("PERSON",)), ("ann", ()), ("ann", ("PLACE",))):
        with pytest.raises(ValueError):
            relational.name_search(text, rows, rows, rows, seen, whole, kinds, 2)
