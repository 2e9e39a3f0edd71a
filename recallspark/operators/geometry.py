"""Joins and selections over boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import boxes, vectors

MIN_IOU, MIN_COSINE = 0.7, 0.9
#: Side of a cell where boxes meet, as a share of the picture.
CELL = 0.5


def _box(side: str) -> list[Column]:
    return [F.col(f"{side}.{c}") for c in ("x0", "y0", "x1", "y1")]


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """Pairs of boxes (aliases a and b) of equal keys that may overlap: an equi-join on the cells of a grid
    that they touch, each pair met in the one cell that holds the corner of what they share. A box is
    shuffled once a cell, so cells should not be smaller than usual boxes."""
    size = F.lit(cell)

    def gridded(rows: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.greatest(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
        return rows.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))

    a, b = gridded(a).alias("a"), gridded(b).alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_cx", "_cy")])
    corner = [F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / size) for c in ("x0", "y0")]
    return pairs.where((corner[0] == F.col("a._cx")) & (corner[1] == F.col("a._cy")))


def related(previous: DataFrame, current: DataFrame, keys: Sequence[str], least: float = MIN_IOU, cosine: float | None = MIN_COSINE) -> DataFrame:
    """(old_id, new_id, overlap, forward, backward): faces (id, keys, x0..y1, vector) of two
    generations that overlap, and are alike if `cosine` is given; forward and backward count the
    candidates of either side. Keys (source, time, space) and grid cells make it an equi-join."""
    pairs = overlapping(previous, current, keys)
    pairs = pairs.withColumn("overlap", boxes.iou_corners(_box("a"), _box("b"))).where(F.col("overlap") >= least)
    if cosine is not None:
        pairs = pairs.where(vectors.cosine(F.col("a.vector"), F.col("b.vector")) >= cosine)
    pairs = pairs.select(F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"), "overlap")
    forward, backward = Window.partitionBy("old_id"), Window.partitionBy("new_id")
    return pairs.withColumn("forward", F.count("*").over(forward)).withColumn("backward", F.count("*").over(backward))


def mutual(pairs: DataFrame) -> DataFrame:
    return pairs.where("forward = 1 and backward = 1").select("old_id", "new_id", "overlap")


def correspond(previous: DataFrame, current: DataFrame, space: str, keys: Sequence[str]) -> DataFrame:
    """(old_id, new_id, status) of every previous face: PAIR, or the first reason that holds."""
    usable = lambda faces: faces.where((F.col("space") == space) & F.col("vector").isNotNull())
    pairs = related(usable(previous), usable(current), keys)
    found = pairs.groupBy("old_id").agg(F.max("forward").alias("n"), F.max("backward").alias("m"), F.min("new_id").alias("new_id"))
    rows = previous.select(F.col("id").alias("old_id"), "space", "vector").join(found, "old_id", "left")
    status = (
        F.when(F.col("space") != space, "SPACE_CHANGED").when(F.col("vector").isNull(), "MISSING_VECTOR")
        .when(F.col("n").isNull(), "NO_CORRESPONDENCE").when((F.col("n") > 1) | (F.col("m") > 1), "AMBIGUOUS").otherwise("PAIR")
    )
    return rows.withColumn("status", status).select("old_id", F.when(F.col("status") == "PAIR", F.col("new_id")).alias("new_id"), "status")


def supersession(previous: DataFrame, current: DataFrame, space: str, keys: Sequence[str]) -> DataFrame:
    """(kind, old_id, new_id, reason): what replaces a generation of faces (with `erased`, `decided`).

    SUPPRESSED: a current face that lies where an erased one was, and nowhere else; CARRIED: a human
    decision that moves to the one face that corresponds; REVIEW: a decision that does not, and why.
    """
    gone = mutual(related(previous.where("erased"), current, keys, cosine=None))
    kept = current.join(gone.select(F.col("new_id").alias("id")), "id", "left_anti")
    alive = previous.where("not erased")
    found = correspond(alive, kept, space, keys).join(alive.where("decided").select(F.col("id").alias("old_id")), "old_id", "left_semi")
    pair = F.col("status") == "PAIR"
    decided = found.select(F.when(pair, "CARRIED").otherwise("REVIEW").alias("kind"), "old_id", "new_id", F.when(~pair, F.col("status")).alias("reason"))
    return decided.unionByName(gone.select(F.lit("SUPPRESSED").alias("kind"), "old_id", "new_id", F.lit(None).cast("string").alias("reason")))


def suppressed(detections: DataFrame, keys: Sequence[str], most: float = 0.4) -> DataFrame:
    """Non-maximum suppression in each frame (keys): by score (ties by id), drop what overlaps a kept
    box more. A frame's boxes are one array, folded in order of score."""
    rows = F.struct(*(F.col(c) for c in detections.columns)).alias("row")
    frames = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col("id").alias("_i"), rows))).alias("all"))
    box = lambda x: [x["row"][c] for c in ("x0", "y0", "x1", "y1")]
    clear = lambda kept, x: F.forall(kept, lambda k: boxes.iou_corners(box(k), box(x)) <= most)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda k, x: F.when(clear(k, x), F.concat(k, F.array(x))).otherwise(k))
    return frames.select(F.explode(kept).alias("k")).select("k.row.*")
