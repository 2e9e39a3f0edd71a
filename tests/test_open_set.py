"""Evaluation of the decision: every row is a query, against a plain version."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from recallspark.operators import retrieval
from recallspark.plans import catalog
from tests.conftest import SF_DIR, same_rows

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def test_two_best_identities_of_every_row(spark, monkeypatch):
    """Many blocks, ties, an identity of one row, rows without an identity."""
    monkeypatch.setattr(retrieval, "PAIRED", 16)
    monkeypatch.setattr(retrieval, "HELD", 64)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[40:60] = v[3]
    who = [None if i % 13 == 0 else 77 if i == 5 else int(rng.integers(0, 6)) for i in range(90)]
    rows = spark.createDataFrame([(i, x.tolist(), w) for i, (x, w) in enumerate(zip(v, who))], "id long, vector array<double>, identity int")
    s = np.round(np.clip(v @ v.T, -1, 1), 6)
    want = {}
    for i in range(90):
        best: dict = {}
        for j in range(90):
            if j != i:
                best[who[j]] = max(best.get(who[j], -2), s[i, j])
        (a, x), (_, y) = sorted(best.items(), key=lambda e: (-e[1], e[0] is None, e[0]))[:2]
        want[i] = (a, float(x), float(y))
    got = retrieval.best_two(rows)
    assert {r["query_id"]: (r["identity"], r["best"], r["second"]) for r in got.collect()} == want
    alone = retrieval.best_two(rows.where("identity = 2")).collect()
    assert len(alone) == who.count(2) and {(r["identity"], r["second"]) for r in alone} == {(2, None)}
    assert retrieval.best_two(rows.where("id = 5")).isEmpty()


def test_leave_one_out_asks_every_row(spark, duck):
    got = QUERIES["leave_one_out"](spark, SF_DIR)
    assert got.count() == got.select("query_id").distinct().count() == spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()


def test_hard_negatives_are_those_of_all_rows(spark, duck):
    """The nearest wrong answers are mostly to rows whose ids are not divisible by 20."""
    wrong = QUERIES["leave_one_out"](spark, SF_DIR).where("not correct").toPandas()
    got = QUERIES["hard_negatives"](spark, SF_DIR).orderBy("rank").toPandas()
    assert got["best"].tolist() == sorted(wrong["best"], reverse=True)[:20] and (got["query_id"] % 20 != 0).any()


def table_of(spark, duck, folder, vectors):
    """The given tables with an `embeddings` of ours: rows (vec_id, embedding, label)."""
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return con


def turned(*degrees):
    return [[float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))] for x in degrees]


def test_the_ceiling_comes_from_every_row(spark, duck, tmp_path):
    """Rows count whose id 20 does not divide: the share of wrong ones is that of all seven."""
    vectors = [(i, v, i % 2 if i < 12 else 5) for i, v in zip((0, 20, 3, 5, 7, 12, 13), turned(0, 40, 90, 100, 200, 300, 320))]
    con = table_of(spark, duck, tmp_path, vectors)
    ask = lambda name: QUERIES[name](spark, str(tmp_path))
    places = ask("leave_one_out").toPandas()
    shares = [(x, (~places["correct"][places["best"] <= x]).mean()) for x in places["best"]]
    assert len(places) == 7 and ask("new_identity_ceiling").first()["ceiling"] == max((x for x, share in shares if share >= 0.99), default=None)
    same_rows(ask("new_identity_ceiling"), con.sql(ORACLES["new_identity_ceiling"]))


def test_a_sweep_counts_every_row(spark, duck, tmp_path):
    """All rows are accepted somewhere at a margin of 0, and margins are compared as they are: 0.57 - 0.56 is a little below 0.01."""
    most = QUERIES["policy_sweep"](spark, SF_DIR).where("margin = 0").agg(F.max("accepted")).first()[0]
    assert most == spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    # row 40 has neighbours at 0.57 (label 1) and 0.56 (label 2); the others are far from them all
    vectors = [(40, [1.0, 0.0, 0.0], 1), (1, [0.57, 0.8216446926, 0.0], 1), (2, [0.56, 0.0, 0.8284925472], 2), (3, [-1.0, 0.0, 0.0], 2)]
    con = table_of(spark, duck, tmp_path, vectors)
    same_rows(QUERIES["policy_sweep"](spark, str(tmp_path)), con.sql(ORACLES["policy_sweep"]))


def test_the_operating_point_is_one_of_the_whole_sweep(spark, duck, tmp_path):
    """Sixty rows of five people around a circle, every seventh under a wrong name."""
    rng = np.random.default_rng(7)
    angle = [72 * (i % 5) + float(rng.normal(0, 6)) for i in range(60)]
    con = table_of(spark, duck, tmp_path, [(i, v, (i + (i % 7 == 0)) % 5) for i, v in enumerate(turned(*angle))])
    places = QUERIES["leave_one_out"](spark, str(tmp_path)).toPandas()
    got = QUERIES["operating_point"](spark, str(tmp_path))
    point = got.first()
    taken = places[(places["best"] >= point["threshold"]) & (places["margin"] >= point["margin"])]
    assert len(places) == 60 and (point["accepted"], point["correct"]) == (len(taken), taken["correct"].sum())
    same_rows(got, con.sql(ORACLES["operating_point"]))
