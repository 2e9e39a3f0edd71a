"""Tracking, selection, suppression and near pictures against plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from recallspark.operators import geometry, pictures
from recallspark.plans import catalog
from recallspark.sources.shipping import ship
from recallspark.streaming import sequence
from tests.conftest import SF_DIR

SCHEMA = "source long, slot long, id long, x0 double, y0 double, x1 double, y1 double, score double, landmarks array<array<double>>, vector array<double>"


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / total if total > 0 else 0.0


def scene(seed: int, sources: int = 3, slots: int = 60) -> list[tuple]:
    """Faces that walk, cross, vanish and come back, some without landmarks or vector."""
    rng, rows, key = random.Random(seed), [], 0
    for source in range(sources):
        walkers = [[rng.random(), rng.random(), rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05), rng.randrange(4)] for _ in range(5)]
        for slot in range(slots):
            if 20 < slot < 27 or rng.random() < 0.15:
                continue
            for w in walkers:
                w[0], w[1] = w[0] + w[2], w[1] + w[3]
                if rng.random() < 0.7:
                    key += 1
                    x, y = w[0] + rng.uniform(-0.02, 0.02), w[1] + rng.uniform(-0.02, 0.02)
                    marks = [[rng.uniform(0.2, 0.8), rng.uniform(0.2, 0.8)] for _ in range(3)] if rng.random() < 0.5 else None
                    face = [math.cos(w[4] * 1.2), math.sin(w[4] * 1.2)] if rng.random() < 0.8 else None
                    rows.append((source, slot, key, x, y, x + 0.3, y + 0.3, round(rng.random(), 3), marks, face))
    rng.shuffle(rows)
    return rows


def plain_tracks(rows: list[tuple], min_iou: float, max_gap: int, veto: float) -> dict[int, tuple]:
    """Every pair of a live track and a face is scored and the best free pair is taken, again and again."""
    out = {}
    for source in {r[0] for r in rows}:
        tracks: list[dict] = []
        for slot in sorted({r[1] for r in rows if r[0] == source}):
            faces = sorted((r for r in rows if r[0] == source and r[1] == slot), key=lambda r: r[2])
            pairs = []
            for n, t in enumerate(tracks):
                if slot - t["slot"] <= max_gap:
                    guess = [p + v * (slot - t["slot"]) for p, v in zip(t["box"], t["speed"])]
                    for f in faces:
                        fit = iou(guess, f[3:7])
                        if fit < min_iou:
                            continue
                        if t["marks"] and f[8]:
                            apart = sum(math.dist(p, q) for p, q in zip(t["marks"], f[8])) / len(f[8])
                            fit *= max(0.0, 1 - apart / 0.5)
                        if t["face"] and f[9] and sum(p * q for p, q in zip(t["face"], f[9])) < veto:
                            continue
                        if fit >= min_iou:
                            pairs.append((-fit, n, f[2], f))
            done_t, done_f = set(), set()
            for _, n, key, f in sorted(pairs, key=lambda p: p[:3]):
                if n not in done_t and key not in done_f:
                    done_t.add(n)
                    done_f.add(key)
                    t = tracks[n]
                    t["speed"] = [(p - q) / max(slot - t["slot"], 1) for p, q in zip(f[3:7], t["box"])]
                    t.update(slot=slot, box=f[3:7], marks=f[8], face=f[9])
                    out[key] = source, n
            for f in faces:
                if f[2] not in done_f:
                    out[f[2]] = source, len(tracks)
                    tracks.append(dict(slot=slot, box=f[3:7], speed=[0.0] * 4, marks=f[8], face=f[9]))
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_track_boxes(spark, batch):
    ship(spark)
    rows = scene(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # slots also end inside batches
    try:
        got = {r["id"]: (r["source"], r["track"]) for r in sequence.track_boxes(spark.createDataFrame(rows, SCHEMA), "source").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_tracks(rows, 0.2, 2, 0.2) and len({t for t in got.values()}) > 10


def test_track_boxes_without_marks_and_empty(spark):
    ship(spark)
    rows = scene(5)
    frame = spark.createDataFrame(rows, SCHEMA).drop("landmarks", "vector")
    bare = [(*r[:8], None, None) for r in rows]
    assert {r["id"]: (r["source"], r["track"]) for r in sequence.track_boxes(frame, "source").collect()} == plain_tracks(bare, 0.2, 2, 0.2)
    assert sequence.track_boxes(frame.where("id < 0"), "source").count() == 0


def plain_kept(rows: list[tuple], keep: int, least: float, gap: int) -> list:
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))  # (id, slot, merit, score)
    good = [r for r in rows if r[3] >= least]
    if not good:
        return [r[0] for r in rows[:1]]
    kept: list = []
    for r in good:
        if len(kept) < keep and all(abs(r[1] - k[1]) >= gap for k in kept):
            kept.append(r)
    kept += [r for r in good if r not in kept][: keep - len(kept)]
    return [r[0] for r in kept]


def test_select_kept(spark):
    rng, rows, key = random.Random(2), [], 0
    for source in range(2):
        for track in range(6):
            for slot in sorted(rng.sample(range(80), rng.randint(1, 60))):
                key += 1
                rows.append((source, track, slot, key, rng.choice([0.2, 0.4, 0.6]) if track != 5 else 0.1, rng.randrange(12) / 10, slot // 20))
    frame = spark.createDataFrame(rows, "source long, track long, slot long, id long, score double, merit double, chunk long")
    tracks, chunks = defaultdict(list), defaultdict(list)
    for s, t, slot, key, score, merit, chunk in rows:
        tracks[s, t].append((key, slot, merit, score))
        chunks[s, t, chunk].append((key, slot, merit, score))
    want = {x for part in tracks.values() for x in plain_kept(part, 4, 0.5, 3)}
    assert {r["id"] for r in sequence.select_kept(frame, ["source", "track"], 4, 0.5, 3).collect()} == want
    capped = defaultdict(list)
    for s, t, chunk in sorted(chunks):
        capped[s, t] += plain_kept(chunks[s, t, chunk], 3, 0.5, 2)
    got = {r["id"] for r in sequence.select_kept(frame, ["source", "track"], 3, 0.5, 2, chunk="chunk", lifetime=5).collect()}
    assert got == {x for part in capped.values() for x in part[:5]}


def test_suppressed(spark):
    rows = [(*r[:8], None, None) for r in scene(6, slots=25)]
    want, frames = set(), defaultdict(list)
    for r in rows:
        frames[r[0], r[1] // 5].append(r)
    for boxes in frames.values():
        kept: list = []
        for r in sorted(boxes, key=lambda r: (-r[7], r[2])):
            if all(iou(r[3:7], k[3:7]) <= 0.4 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "slot div 5 as frame").drop("landmarks", "vector")
    out = geometry.suppressed(frame, ["source", "frame"])
    assert out.columns == frame.columns and {r["id"] for r in out.collect()} == want and len(want) < len(rows)


def test_near_pictures(spark):
    rng = random.Random(8)
    prints = []
    for _ in range(120):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            prints.append(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
    prints += [prints[0]] * 5
    order = list(range(len(prints)))
    rng.shuffle(order)
    kept: list = []
    for i in range(len(order)):
        if all((prints[order[i]] ^ prints[order[k]]).bit_count() > 5 for k in kept):
            kept.append(i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, signed(prints[o])) for i, o in enumerate(order)], "picture_id long, bits long")
    got = {r["picture_id"]: r["kept"] for r in pictures.first_of_near(frame, 5).collect()}
    assert got == {i: i in kept for i in range(len(order))}


def test_difference_hash(spark):
    grey = np.random.default_rng(3).integers(0, 255, (8, 9))
    bits = sum(1 << k for k, on in enumerate((grey[:, :-1] > grey[:, 1:]).reshape(-1).tolist()) if on)
    frame = spark.createDataFrame([(grey.reshape(-1).tolist(),)], "g array<int>")
    assert frame.select(pictures.difference_hash(frame["g"], 9, 8).alias("h")).first()["h"] % (1 << 64) == bits


def test_cluster_unknown(spark, duck):
    pairs = duck.sql("""WITH r AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings WHERE vec_id % 17 = 0 AND vec_id % 23 <> 0 AND vec_id % 11 <> 0)
SELECT a.id, b.id, round(list_dot_product(a.v, b.v), 6) >= 0.3 FROM r a JOIN r b ON a.id <= b.id""").fetchall()
    up = {a: a for a, _, _ in pairs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, near in pairs:
        if near:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert {r["id"]: r["cluster_id"] for r in catalog.queries()["cluster_unknown"](spark, SF_DIR).collect()} == {x: root(x) for x in up}


def test_keys_of_near_pictures_are_never_broadcast(spark, tmp_path):
    """A small table of prints has 84 keys a print, which Spark does not reckon with."""
    spark.range(3000).selectExpr("id as picture_id", "xxhash64(id) as bits").write.parquet(str(tmp_path / "prints"))
    plan = pictures.near_pairs(spark.read.parquet(str(tmp_path / "prints")), 8)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
