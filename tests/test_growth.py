"""What keeps queries in proportion to their input, seen in their plans and in what they shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from recallspark.functions import names
from recallspark.operators import geometry, pictures
from recallspark.plans import catalog
from recallspark.sources import views
from recallspark.streaming import sequence
from tests.conftest import SF_DIR


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_not_tried_against_every_special_character(spark):
    rows = spark.createDataFrame([("Stra\u00dfe \ufb01n \u0130",), ("plain",), ("",), (None,)], "name string")
    found = rows.select(names.case_folded(F.col("name")).alias("folded"), names.slug(F.col("name")).alias("slug"))
    assert "rlike" not in plan_of(found).lower()
    assert [r["folded"] for r in found.collect()] == [None if r["name"] is None else r["name"].casefold() for r in rows.collect()]
    assert [r["slug"] for r in found.collect()] == ["Strae_fin_I", "plain", "", None]


def test_a_box_travels_to_few_cells(spark):
    cells = lambda lo, hi: F.floor(F.col(hi) / geometry.CELL) - F.floor(F.col(lo) / geometry.CELL) + 1
    mean = views.detections(spark, SF_DIR).agg(F.avg(cells("x0", "x1") * cells("y0", "y1"))).first()[0]
    assert mean < 3 and geometry.overlapping.__defaults__ == (geometry.CELL,)


def test_keys_of_a_configuration_are_counted_one_kind_a_pass(spark):
    assert "Expand" not in plan_of(catalog.queries()["configuration_tree"](spark, SF_DIR))


def test_few_boxes_fit_alike_one_by_one():
    rng = np.random.default_rng(4)
    tracks = sequence.Tracks(0.2, 24, 0.2)
    for now in range(0, 60, 3):
        box = np.round(rng.random((3, 2)) * 0.4, 1)
        boxes = np.concatenate([box, box + 0.2 + rng.integers(0, 3, (3, 2)) / 20], axis=1)
        shapes = [None if rng.random() < 0.2 else rng.random((5, 2)) for _ in range(3)]
        faces = [None if rng.random() < 0.2 else rng.random(2) - 0.3 for _ in range(3)]
        few, fits = tracks.few(now, boxes, shapes, faces), tracks.fits(now, boxes, shapes, faces)
        assert [(-x, t, b) for x, t, b in few] == [tuple(r) for r in fits.tolist()]
        tracks.place(now, boxes, shapes, faces)


def test_a_print_travels_nine_times(spark):
    """Of prints 8 apart some third differs in two places at most, and one of its bands in none: nine bands, not 84 keys."""
    rng = np.random.default_rng(8)
    bands = pictures.bands(8)
    assert len(bands) == 9
    for _ in range(2000):
        flips = sum(1 << int(k) for k in rng.choice(64, 8, replace=False))
        part = lambda lo, hi: (flips >> lo) & ((1 << (hi - lo)) - 1)
        assert any(part(at, to) == 0 and part(lo, hi).bit_count() <= 2 for lo, hi, at, to in bands)
    prints = spark.range(500).selectExpr("id as picture_id", "xxhash64(id) as bits")
    assert "Generate explode(array(" in plan_of(pictures.near_pairs(prints, 8)) and plan_of(pictures.near_pairs(prints, 8)).count("Generate") == 1


def test_hot_prints_are_cut_into_blocks(spark, monkeypatch):
    """Prints that share most bits are compared in blocks and in small groups, each two once."""
    monkeypatch.setattr(pictures, "BUCKET", 40)
    monkeypatch.setattr(pictures, "HELD", 100)
    monkeypatch.setattr(pictures, "FEW", 2)
    rng = np.random.default_rng(2)
    prints = sorted({int(x) for x in rng.integers(0, 1 << 20, 150) * 4093 % (1 << 26)} | {-int(x) for x in rng.integers(1, 1 << 62, 60)})
    prints = sorted({*prints, *(x ^ 5 << (k % 60) for k, x in enumerate(prints[::4]))})
    frame = spark.createDataFrame([(1000 - k, x) for k, x in enumerate(prints)], "picture_id long, bits long")
    for bits in (2, 8):
        got = sorted(map(tuple, pictures.near_pairs(frame, bits).collect()))
        near = [(k, j) for k in range(len(prints)) for j in range(k) if ((prints[k] ^ prints[j]) % (1 << 64)).bit_count() <= bits]
        assert got == sorted((1000 - k, 1000 - j) for k, j in near) and near
