"""The live operators over cut streams: equal to the batch tracker and to plain folds, resumed or not."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from recallspark.sources.shipping import ship
from recallspark.streaming import live, sequence
from tests.test_sequence import SCHEMA, plain_tracks, scene

RATE, START = 1.0, 1_000_000


def written(spark, path, rows, parts):
    """Detections in files, cut at any row; a file is a micro-batch."""
    rows = sorted(rows, key=lambda r: (r[1], r[0], r[2]))
    cuts = [0, *sorted(random.Random(len(parts)).sample(range(1, len(rows)), len(parts) - 1)), len(rows)] if isinstance(parts, list) else parts
    frame = lambda some: spark.createDataFrame([(*r, datetime.fromtimestamp(START + r[1], UTC)) for r in some], SCHEMA + ", ts timestamp")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        frame([(r[0], r[1] + START, *r[2:]) for r in rows[a:b]]).withColumn("ts", F.col("slot").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/k={k:03d}")
    return cuts


def stream_of(spark, path):
    rows = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))
    return rows.withWatermark("ts", "1 second")


def by_id(*tables):
    found = [(r["id"], (r["source"], r["track"])) for t in tables for r in t.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_a_cut_stream_gives_the_tracks_of_the_batch(spark, tmp_path):
    """Batches cut slots; what waits at the end is placed from the state, which holds no ended track."""
    ship(spark)
    rows = scene(11, sources=2, slots=45)
    written(spark, tmp_path / "in", rows, [None] * 4)
    placed, state = live.run(live.track_stream(stream_of(spark, tmp_path / "in"), "source", RATE), "tracks", str(tmp_path / "run"))
    left = live.tracker_state(spark, state, "source")
    assert by_id(placed, live.placed_at_the_end(left, "source")) == plain_tracks(rows, 0.2, 2, 0.2)
    for r in left.collect():
        newest = max(x[1] for x in rows if x[0] == r["source"]) + START
        assert all(newest - t["slot"] <= 2 for t in r["live"])


@pytest.mark.parametrize("seed", [3])
def test_a_run_resumes_from_a_written_state(spark, tmp_path, seed):
    """A first run ends between two files; the second starts from its state as a table, elsewhere."""
    ship(spark)
    rows = sorted(scene(seed, sources=2, slots=40), key=lambda r: (r[1], r[0], r[2]))
    half = len(rows) // 2 + 1
    cut = {r[0]: r[1] for r in rows[:half]}
    first, second = rows[:half], rows[half:]
    written(spark, tmp_path / "a", first, [0, half // 2, half])
    one, at = live.run(live.track_stream(stream_of(spark, tmp_path / "a"), "source", RATE), "tracks", str(tmp_path / "one"))
    live.tracker_state(spark, at, "source").write.parquet(str(tmp_path / "state"))
    saved = spark.read.parquet(str(tmp_path / "state"))
    written(spark, tmp_path / "b", second, [0, 5, len(second)])
    two, at = live.run(live.track_stream(stream_of(spark, tmp_path / "b"), "source", RATE, state=saved), "tracks", str(tmp_path / "two"))
    assert by_id(one, two, live.placed_at_the_end(live.tracker_state(spark, at, "source"), "source")) == plain_tracks(rows, 0.2, 2, 0.2)
    assert cut  # both sources were met before the cut


def fold(rows, max_gap, most):
    """Encounters with their pools, row by row: the pool is a list whose first worst face makes room."""
    out, now = [], {}
    for source, slot, key, merit, gap in sorted(rows, key=lambda r: (r[0], r[1], not r[4], r[2])):
        have = now.get(source)
        if have and (gap or slot - have[1] > max_gap):
            out.append((source, *have[:3], tuple(have[3])))
            have = now[source] = None
        if gap:
            continue
        have = have or [slot, slot, 0, []]
        have[1], have[2] = slot, have[2] + 1
        pool = have[3]
        worst = min((m for m, _ in pool), default=None)
        if len(pool) == most and merit > worst:
            pool.remove(next(x for x in pool if x[0] == worst))
        if len(pool) < most:
            pool.append((merit, key))
        now[source] = have
    return Counter(out), Counter((s, *h[:3], tuple(h[3])) for s, h in now.items() if h)


def pools_of(df):
    return Counter((r["source"], r["first_slot"], r["last_slot"], r["seen"], tuple((p["merit"], p["id"]) for p in r["pool"])) for r in df.collect())


def pool_rows(seed):
    rng, rows, key = random.Random(seed), [], 0
    for source in ("a", "b", "c"):
        slot = START
        for _ in range(70):
            slot += rng.choice([0, 1, 1, 2, 3, 7])
            key += 1
            rows.append((source, slot, key, rng.randrange(6) / 2, rng.random() < 0.05))
    return rows


def pool_stream(spark, path, rows, cuts):
    schema = "source string, slot long, id long, merit double, gap boolean"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).withColumn("ts", F.col("slot").cast("timestamp")).coalesce(1).write.parquet(f"{path}/k={k:03d}")
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path)).withWatermark("ts", "5 seconds")


def test_pools_of_encounters(spark, tmp_path):
    """Closed ones and, at the end of the input, open ones, with pools of three: a plain fold; and over two runs."""
    ship(spark)
    rows = sorted(pool_rows(2), key=lambda r: (r[1], not r[4], r[2]))  # a gap comes before the faces of its slot
    closed, left = fold(rows, 4, 3)
    n = len(rows)
    stream = pool_stream(spark, tmp_path / "in", rows, [0, n // 3, n // 2, n])
    done, at = live.run(live.pooled_encounters(stream, "source", 4, RATE, most=3), "pools", str(tmp_path / "run"))
    still = live.open_pools(spark, at, "source")
    assert pools_of(done) + pools_of(still) == closed + left and not pools_of(done) - (closed + left)
    half = n // 2
    one, at = live.run(live.pooled_encounters(pool_stream(spark, tmp_path / "a", rows, [0, half]), "source", 4, RATE, most=3), "pools", str(tmp_path / "one"))
    live.open_pools(spark, at, "source").write.parquet(str(tmp_path / "open"))
    again = live.pooled_encounters(pool_stream(spark, tmp_path / "b", rows, [half, n]), "source", 4, RATE, most=3, state=spark.read.parquet(str(tmp_path / "open")))
    two, at = live.run(again, "pools", str(tmp_path / "two"))
    assert pools_of(one) + pools_of(two) + pools_of(live.open_pools(spark, at, "source")) == closed + left


def test_pool_replaces_its_worst_for_a_better_face_only():
    pool = []
    for k, merit in enumerate([1.0, 1.0, 2.0, 1.0, 2.0, 2.0]):
        pool = live.pooled(pool, (merit, 0, k), 2)
    assert pool == [(2.0, 0, 2), (2.0, 0, 4)]


def test_silence_and_late_faces():
    """Numbers go on after a silence; a face behind the last slot gets no track; an empty frame ends tracks."""
    box = [0.1, 0.1, 0.3, 0.3]
    placing = live.Placing(0.2, 2, 0.2)
    face = lambda slot, key, b=box: (slot, key, b, None, None)
    assert placing.place([face(5, 1), face(6, 2)]) == [(5, 1, 0), (6, 2, 0)]
    assert placing.place([face(4, 3)]) == [(4, 3, None)]
    assert placing.place([face(9, 4, None), face(10, 5)]) == [(10, 5, 1)]
    kept = placing.live(10)
    again = live.Placing(0.2, 2, 0.2, placing.tracks.begun, placing.last, kept)
    assert again.place([face(11, 6), face(20, 7)]) == [(11, 6, 1), (20, 7, 2)]
    assert kept[1][5:] == (10, 1) and again.live(20) == {2: (20, box, [0.0] * 4, None, None, 20, 1)}


def test_batch_tracker_agrees(spark):
    ship(spark)
    rows = scene(4, sources=1, slots=25)
    got = {r["id"]: (r["source"], r["track"]) for r in sequence.track_boxes(spark.createDataFrame(rows, SCHEMA), "source").collect()}
    placing = live.Placing(0.2, 2, 0.2)
    faces = [(r[1], r[2], list(r[3:7]), r[8], r[9]) for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert {k: (0, t) for _, k, t in placing.place(faces)} == got


def test_stream_query_gives_the_tracks_of_the_batch_query(spark):
    from recallspark.plans import catalog
    from tests.conftest import SF_DIR

    found = {name: {(r["source_id"], r["slot"], r["id"], r["track"]) for r in catalog.queries()[name](spark, SF_DIR).select("source_id", "slot", "id", "track").collect()} for name in ("stream_tracks", "track_boxes")}
    assert found["stream_tracks"] == found["track_boxes"] and len(found["track_boxes"]) > 900


def test_faces_travel_as_json_until_their_slot_is_placed():
    faces = [(k, k, [0.0, 0.0, 1.0, 1.0], [[0.1, 0.2], [0.3, 0.4]] if k % 2 else None, [1.0, 0.0] if k % 4 < 2 else [0.0, 1.0]) for k in range(12)]
    texts = [(*f[:3], *(None if x is None else json.dumps(x) for x in f[3:])) for f in faces]
    plain = live.Placing(0.2, 2, 0.2).place(faces)
    assert live.Placing(0.2, 2, 0.2).place(texts) == plain
    assert len({x[2] for x in plain}) > 1
