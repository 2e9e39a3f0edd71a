"""Families, exclusive samples, transforms, feeds, interval joins and picture keys against plain versions."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.functions import boxes
from recallspark.operators import history, lifecycle, pictures, relational
from recallspark.plans import catalog, closures
from tests.conftest import SF_DIR


def test_family_of_roots_ends_on_cycles(spark):
    merged = {1: None, 2: 1, 3: 2, 4: 2, 5: 1, 10: 12, 11: 10, 12: 11, 13: 12, 20: None, 21: 20, 30: 30, 40: None}
    chain = spark.createDataFrame(list(merged.items()), "identity_id long, merged_into long")
    roots = spark.createDataFrame([(1,), (2,), (10,), (30,), (40,), (99,), (None,), (1,)], "identity_id long")
    got = {}
    for r in lifecycle.family_of(chain, roots).collect():
        got.setdefault(r["root"], []).append(r["member"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 3, 4, 5], 2: [2, 3, 4], 10: [10, 11, 12, 13], 30: [30], 40: [40], 99: [99]}


def taken_in_turn(files, least, people, most):
    """One person after the other, in the order of the salted hash."""
    own = {}
    for person, place, digest in sorted((f for f in files if f[0] is not None), key=lambda f: f[1]):
        own.setdefault(person, {}).setdefault(digest, place)
    taken, out, count = set(), set(), 0
    for person in sorted(own, key=lambda n: (hashlib.sha256(f"sample:{n}".encode()).hexdigest(), n)):
        free = sorted((place, digest) for digest, place in own[person].items() if digest not in taken)
        if len(free) >= least and count < people:
            count += 1
            taken |= {digest for _, digest in free[:most]}
            out |= {(person, place) for place, _ in free[:most]}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_sample_with_exclusive_pictures(spark, seed):
    rng, files = random.Random(seed), []
    for n in range(25):
        for _ in range(rng.randint(1, 9)):
            files.append((f"person {n}", len(files), f"d{rng.randrange(60)}"))
    files += [(f"person {n}", 1000 + n, "everywhere") for n in range(25)] + [(None, 2000, "d1")]
    frame = spark.createDataFrame(files, "person string, place long, digest string").repartition(4)
    for people in (6, 100):
        got = {tuple(r) for r in pictures.sampled(frame, "person", "place", "digest", 3, people, 4).collect()}
        assert got == taken_in_turn(files, 3, people, 4)
    assert pictures.sampled(frame.limit(0), "person", "place", "digest", 3, 5, 4).isEmpty()


def fitted(source, target):
    """The transform by singular values, as published."""
    s, t = np.array(source, float), np.array(target, float)
    ms, mt = s.mean(axis=0), t.mean(axis=0)
    size = ((s - ms) ** 2).sum() / len(s)
    u, d, v = np.linalg.svd((t - mt).T @ (s - ms) / len(s))
    sign = np.array([1.0, -1.0 if np.linalg.det(u) * np.linalg.det(v) < 0 else 1.0])
    turn = (d * sign).sum() / size * (u @ np.diag(sign) @ v)
    return np.hstack([turn, (mt - turn @ ms)[:, None]])


def test_similarity_transform(spark):
    rng = np.random.default_rng(3)
    cases = [(rng.normal(size=(n, 2)) * 10.0**k + 100, rng.normal(size=(n, 2)) * 50) for n in (2, 3, 5, 9) for k in (-2, 0, 3)]
    cases += [(a, a @ np.array([[1, 0], [0, -1.0]]) + 3) for a, _ in cases[:6]]  # mirrored
    odd = [([[5.5, 1.25]] * 5, [[1.0, 2.0]] * 5), ([[1.0, 2.0]], [[3.0, 4.0]]), ([], []), ([[0.0, 0.0], [1.0, 1.0]], [[1.0, 1.0]]), ([[0.0, 0.0], [1.0, 0.0]], [[7.0, 7.0], [7.0, 7.0]]),
           ([[float("nan"), 0.0], [1.0, 0.0]], [[1.0, 1.0], [2.0, 2.0]]), (None, [[1.0, 1.0]]), ([[0.0, 0.0], [float("inf"), 0.0]], [[1.0, 1.0], [2.0, 2.0]])]
    rows = [(k, np.asarray(a).tolist(), np.asarray(b).tolist()) for k, (a, b) in enumerate(cases)] + [(100 + k, a, b) for k, (a, b) in enumerate(odd)]
    frame = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {r["k"]: r["m"] for r in frame.select("k", boxes.similarity_transform(F.col("a"), F.col("b")).alias("m")).collect()}
    for k, (a, b) in enumerate(cases):
        want = fitted(a, b)
        assert np.allclose(np.array(got[k]), want, atol=1e-9 * max(1, np.abs(want).max()), rtol=1e-9)
    assert all(got[100 + k] is None for k in range(len(odd)))


def test_feed_leads_from_one_snapshot_to_the_other(spark):
    old, new = closures.snapshots(spark, SF_DIR)
    feed = relational.changes(old, new, "order_id")
    rows = feed.orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["order_id"] for r in rows] == sorted(r["order_id"] for r in rows)
    assert {r["kind"] for r in rows} == {"INSERT", "UPDATE", "DELETE"}
    after = sorted(map(str, relational.followed(old, feed, "order_id").collect()))
    assert after == sorted(map(str, new.select(old.columns).collect()))
    assert relational.changes(new, new, "order_id").isEmpty() and relational.changes(old.limit(0), old.limit(0), "order_id").isEmpty()


def test_numbers_without_gaps(spark):
    rows = spark.range(0, 5000, 3).select(F.xxhash64("id").alias("a"), "id").unionByName(spark.range(7).select(F.lit(5).cast("long").alias("a"), (-F.col("id") - 1).alias("id")))
    got = relational.in_sequence(rows, ["a", "id"], "n", 10).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(10, 10 + len(got)))
    assert [(r["a"], r["id"]) for r in got] == sorted((r["a"], r["id"]) for r in got)


def test_overlapping_pairs(spark):
    rng = random.Random(4)
    spans = lambda n, k: [(rng.randrange(3), s := rng.randrange(5000), s + rng.choice([0, 1, 7, 8, 9, 63, 64, 400, 4000]), k + i) for i in range(n)]
    a, b = spans(150, 0), spans(150, 1000)
    left = spark.createDataFrame(a, "key int, start long, end long, id long")
    right = spark.createDataFrame(b, "key int, start long, end long, id long")
    for base in (1, 8, 10_000):
        got = history.overlapping_pairs(left, right, ["key"], base).select("id", "other_id").collect()
        want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]}
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    assert history.overlapping_pairs(left.limit(0), right, ["key"], 8).isEmpty()


def test_a_long_span_does_not_fan_out(spark):
    """A span of a million bins comes in a few rows, whatever its length."""
    rows = spark.createDataFrame([(0, 1_000_000_000), (5, 5), (77, 80)], "start long, end long")
    assert history._binned(rows, 10, 27).count() <= 2 * 28 * 3


def test_any_four_bands_hold_a_triple():
    for bands in (8, 10, 12, 13):
        triples = {frozenset(t) for t in pictures.band_triples(bands)}
        assert all(any(frozenset(t) in triples for t in combinations(four, 3)) for four in combinations(range(bands), 4))
    assert len(pictures.band_triples(12)) == 84


def test_near_pairs_are_all_found(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for x in prints[:30]:
        for _ in range(4):
            for k in rng.sample(range(64), rng.choice([1, 7, 8, 9])):
                x ^= 1 << k
            prints.append(x)
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(k, signed(x)) for k, x in enumerate(prints)], "picture_id long, bits long")
    for bits in (4, 8):
        got = sorted(map(tuple, pictures.near_pairs(frame, bits).collect()))
        assert got == [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= bits]


def test_all_pictures_are_looked_at(spark):
    assert catalog.queries()["near_pictures"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
