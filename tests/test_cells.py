"""The inverted-file index against brute force, and meetings of blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.operators import cells, retrieval
from recallspark.plans import catalog
from tests.conftest import SF_DIR

SCHEMA = "id long, vector array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(gallery, queries, k):
    """{query_id: ids} of the k nearest other rows."""
    ids = np.array(sorted(gallery))
    g = np.array([gallery[i] for i in ids])
    out = {}
    for q, v in queries.items():
        s = np.round(np.clip(g @ v, -1, 1), 6)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def clustered(n, seed=0):
    """Vectors around sixty centres, with a third of all rows being copies of one."""
    rng = np.random.default_rng(seed)
    centre = unit(rng.normal(size=(60, 32)))
    v = unit(centre[rng.integers(0, 60, n)] + 0.12 * rng.normal(size=(n, 32)))
    v[: n // 3] = v[0]
    order = rng.permutation(n)
    return {int(i): x for i, x in zip(order, v)}


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], SCHEMA).repartition(5)


@pytest.mark.parametrize("rows", [32_768, 64])
def test_recall_and_scored_pairs(spark, monkeypatch, rows):
    """Clustered rows, a hot cell cut into blocks: few probes, few scored pairs, exact scores, recall of 0.9 at least."""
    monkeypatch.setattr(cells, "ROWS", rows)
    monkeypatch.setattr(cells, "PROBES", max(16, rows // 64))
    vectors = clustered(1500)
    gallery = rows_of(spark, vectors)
    asked = {i: v for i, v in vectors.items() if i % 20 == 0}
    index = cells.built(gallery)
    assert index.rows.count() == 1500 and index.probes < len(index.centroids) / 3
    queries = rows_of(spark, asked).withColumnRenamed("id", "query_id")
    got = {}
    for r in cells.nearest_indexed(index, queries, gallery, 10, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append(r)
        assert r["id"] != r["query_id"] and r["scored"] == min(30, r["met"])
        assert abs(r["similarity"] - round(float(np.clip(asked[r["query_id"]] @ vectors[r["id"]], -1, 1)), 6)) < 2e-6
    want = exact(vectors, asked, 10)
    alike = lambda q, i: round(float(np.clip(vectors[q] @ vectors[i], -1, 1)), 5)
    found = sum(sum(alike(q, r["id"]) >= alike(q, want[q][-1]) for r in got[q]) for q in asked)
    assert found >= 0.9 * 10 * len(asked)
    assert all([r["rank"] for r in sorted(rs, key=lambda r: r["rank"])] == list(range(1, 11)) for rs in got.values())


def test_all_probes_find_the_exact_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = {i: v for i, v in enumerate(unit(rng.normal(size=(400, 24))))}
    gallery = rows_of(spark, vectors)
    index = cells.built(gallery)
    whole = cells.Index(index.centroids, len(index.centroids), index.rows)
    asked = {i: v for i, v in vectors.items() if i % 20 == 0}
    got = {}
    for r in sorted(cells.nearest_indexed(whole, rows_of(spark, asked).withColumnRenamed("id", "query_id"), gallery, 5, exclude_self=True).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
        assert r["met"] == 399 and r["scored"] == 15
    assert got == exact(vectors, asked, 5)


def test_an_index_is_saved_opened_and_appended_to(spark, tmp_path):
    vectors = clustered(300, 2)
    old, new = {i: v for i, v in vectors.items() if i < 250}, {i: v for i, v in vectors.items() if i >= 250}
    cells.saved(cells.built(rows_of(spark, old)), f"{tmp_path}/index")
    cells.appended(spark, f"{tmp_path}/index", rows_of(spark, new))
    index = cells.opened(spark, f"{tmp_path}/index")
    assert {r["id"] for r in index.rows.select("id").collect()} == set(vectors)
    queries = rows_of(spark, new).withColumnRenamed("id", "query_id")
    best = {r["query_id"]: r["similarity"] for r in cells.nearest_indexed(index, queries, rows_of(spark, vectors), 1).collect()}
    assert best == {i: 1.0 for i in new}


def test_rows_that_are_not_indexed(spark):
    data = [(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [1.0]), (4, []), (5, [0.0, 1.0]), (5, [0.0, 1.0])]
    index = cells.built(spark.createDataFrame(data, SCHEMA))
    assert sorted(r["id"] for r in index.rows.collect()) == [1, 5, 5]
    assert cells.built(spark.createDataFrame([], SCHEMA)).rows.isEmpty()


def test_indexed_query_reaches_its_recall(spark):
    got = catalog.queries()["knn_indexed"](spark, SF_DIR).collect()
    asked = {r["query_id"]: r for r in got}
    assert sum(r["recall"] for r in asked.values()) / len(asked) >= 0.9
    gallery = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert max(r["scored"] for r in got) < gallery / 10


def test_every_two_blocks_meet_once(spark, monkeypatch):
    """Pairs and counts of scores over many blocks are those of a plain double loop."""
    monkeypatch.setattr(retrieval, "BLOCK", 20)
    monkeypatch.setattr(retrieval, "PAIRED", 24)
    rng = np.random.default_rng(6)
    v = unit(rng.normal(size=(90, 6)))
    v[7] = v[3]
    who = rng.integers(0, 4, 90)
    rows = spark.createDataFrame([(i, x.tolist(), int(w)) for i, (x, w) in enumerate(zip(v, who))], SCHEMA + ", identity long")
    s = np.round(np.clip(v @ v.T, -1, 1), 6)
    near = {(r["a"], r["b"]) for r in retrieval.close_pairs(rows, 0.5).collect()}
    assert near == {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.5}
    counts = {(r["genuine"], round(r["s"], 6)): r["n"] for r in retrieval.pair_scores(rows).collect()}
    want = {}
    for i in range(90):
        for j in range(i + 1, 90):
            k = bool(who[i] == who[j]), round(float(s[i, j]), 6)
            want[k] = want.get(k, 0) + 1
    assert counts == want


def test_copies_beyond_the_candidates_go_by_id(spark):
    """Ninety copies of one vector are nearer than the rest: of equal rows the smallest ids are found."""
    rng = np.random.default_rng(3)
    v = unit(rng.normal(size=(200, 8)))
    twin = set(rng.permutation(200)[:90].tolist())
    for i in twin:
        v[i] = v[min(twin)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(1, "vector").sortWithinPartitions(F.desc("id"))
    asked = rows.where(F.col("id") == max(twin)).withColumnRenamed("id", "query_id")
    index = cells.built(rows, 10)
    index = cells.Index(index.centroids, len(index.centroids), index.rows)
    got = cells.nearest_indexed(index, asked, rows, 10, exclude_self=True).orderBy("rank").collect()
    assert [r["id"] for r in got] == sorted(twin)[:10] and {r["met"] for r in got} == {199}


def test_the_nearest_are_found_where_many_rows_are_close(spark):
    """Two hundred rows of a cluster differ by less than a byte a dimension tells; what is met is ranked as by the vectors."""
    rng = np.random.default_rng(12)
    centre = unit(rng.normal(size=(3, 24)))
    v = unit(centre[rng.integers(0, 3, 600)] + 0.004 * rng.normal(size=(600, 24)))
    v[500:520] = v[7]
    vectors = dict(enumerate(v))
    rows, asked = rows_of(spark, vectors), {i: x for i, x in vectors.items() if i % 20 == 0}
    index = cells.built(rows, 10)
    index = cells.Index(index.centroids, len(index.centroids), index.rows)
    got = {}
    for r in cells.nearest_indexed(index, rows_of(spark, asked).withColumnRenamed("id", "query_id"), rows, 10, exclude_self=True).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
        assert r["met"] == 599 and 30 <= r["scored"] < 100
    assert got == exact(vectors, asked, 10)


def test_equal_cells_tie():
    """A product's last bits depend on the column; a row goes to the first of equal cells."""
    rng = np.random.default_rng(1)
    centre = unit(rng.normal(size=(341, 64)))
    centre[1::2] = centre[1]
    near = cells._nearest_cells(rng.normal(size=(1024, 64)), centre, 341)
    place = np.argsort(near, axis=1)
    assert (np.diff(place[:, 1::2], axis=1) == 1).all()
