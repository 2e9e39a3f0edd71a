"""Column expressions over boxes: corners (x0, y0, x1, y1) or origin and size (x, y, w, h)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def iou_corners(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def corners(box: Box) -> list[Column]:
    return [box[0], box[1], box[0] + box[2], box[1] + box[3]]


def iou_sized(a: Box, b: Box) -> Column:
    return iou_corners(corners(a), corners(b))


def area(box: Box) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def valid(box: Box, least: float = 0.0) -> Column:
    """Four finite numbers, in order, both sides above `least`."""
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) for x in box]
    ok = finite[0] & finite[1] & finite[2] & finite[3] & (box[2] - box[0] > least) & (box[3] - box[1] > least)
    return F.coalesce(ok, F.lit(False))


def touches_border(box: Box, width: Column, height: Column) -> Column:
    return (box[0] <= 0) | (box[1] <= 0) | (box[2] >= width) | (box[3] >= height)


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def shape(points: Column, box: Box) -> Column:
    """Landmarks (an array of [x, y]) in coordinates of the box, whose sides count at least 1e-9."""
    w, h = F.greatest(box[2] - box[0], F.lit(1e-9)), F.greatest(box[3] - box[1], F.lit(1e-9))
    return F.transform(points, lambda p: F.array((p[0] - box[0]) / w, (p[1] - box[1]) / h))


def agreement(a: Column, b: Column) -> Column:
    """1 for equal shapes down to 0 at a mean distance of 0.5; 1 if one is missing."""
    apart = F.zip_with(a, b, lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1]))
    mean = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x) / F.size(a)
    return F.when(mean.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - mean / 0.5))


def frontal(points: Column) -> Column:
    """1 for a nose (third point) midway between the eyes (first two), less with its distance from there
    in eye distances, 0.1 at least; 1 without three landmarks."""
    left, right, nose = (F.get(F.get(points, F.lit(i)), F.lit(0)) for i in range(3))
    eyes = F.abs(right - left)
    turned = F.greatest(F.lit(0.1), 1 - F.abs(nose - (left + right) / 2) / F.when(eyes > 0, eyes))
    return F.when(F.coalesce(F.size(points), F.lit(0)) < 3, 1.0).otherwise(F.coalesce(turned, F.lit(0.1)))


def merit(score: Column, box: Box, frontal: Column) -> Column:
    return score * F.sqrt(area(box)) * frontal


def scaled(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Frame size with the longer side at `most`, rounded half to even, at least 1."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.bround(x * ratio, 0).cast("int")) for x in (width, height))


def crop(box: Box, width: Column, height: Column, margin: float = 0.5) -> list[Column]:
    """Box with a margin of its own size, clipped to the frame."""
    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    floor = lambda x: F.greatest(F.lit(0), F.floor(F.round(x, 6)).cast("int"))
    ceil = lambda x, most: F.least(most, F.ceil(F.round(x, 6)).cast("int"))
    return [floor(box[0] - w), floor(box[1] - h), ceil(box[2] + w, width), ceil(box[3] + h, height)]


def similarity_transform(source: Column, target: Column) -> Column:
    """[[a, -b, x], [b, a, y]]: the least-squares turn, scale and shift, never a reflection, of points (arrays of [x, y])
    onto others. NULL if they differ in number or one is not finite, if all source points are one (variance below
    1e-12), or if no turn is better than another.

    In the plane a turn with scale is a complex factor, so the fit is closed: one fold sums the products of the points,
    each less the first one."""
    at = lambda p, i: F.get(p, F.lit(i))
    less = lambda points, p, i: at(p, i) - at(at(points, 0), i)
    pairs = F.zip_with(source, target, lambda p, q: F.struct(less(source, p, 0).alias("x"), less(source, p, 1).alias("y"), less(target, q, 0).alias("u"), less(target, q, 1).alias("v")))
    terms = {
        "n": lambda p: F.lit(1.0), "x": lambda p: p["x"], "y": lambda p: p["y"], "u": lambda p: p["u"], "v": lambda p: p["v"],
        "own": lambda p: p["x"] * p["x"] + p["y"] * p["y"], "along": lambda p: p["x"] * p["u"] + p["y"] * p["v"], "across": lambda p: p["x"] * p["v"] - p["y"] * p["u"],
    }
    sums = F.aggregate(pairs, F.struct(*(F.lit(0.0).alias(k) for k in terms)), lambda s, p: F.struct(*((s[k] + f(p)).alias(k) for k, f in terms.items())))
    # an array of one, so that each step sees the last one's values instead of computing them again
    step = lambda row, f: F.transform(F.array(row) if isinstance(row, Column) else row[0], f)
    some = F.when(F.size(source) == F.size(target), F.when(F.size(source) > 0, sums))
    centred = step(some, lambda s: F.struct(
        s["n"].alias("n"), (s["x"] / s["n"]).alias("x"), (s["y"] / s["n"]).alias("y"), (s["u"] / s["n"]).alias("u"), (s["v"] / s["n"]).alias("v"),
        (s["own"] - (s["x"] * s["x"] + s["y"] * s["y"]) / s["n"]).alias("own"), (s["along"] - (s["x"] * s["u"] + s["y"] * s["v"]) / s["n"]).alias("along"),
        (s["across"] - (s["x"] * s["v"] - s["y"] * s["u"]) / s["n"]).alias("across"),
    ))
    turned = step([centred], lambda s: F.when((s["own"] >= 1e-12 * s["n"]) & (F.abs(s["own"]) < F.lit(float("inf"))), F.struct((s["along"] / s["own"]).alias("a"), (s["across"] / s["own"]).alias("b"), s["x"].alias("x"), s["y"].alias("y"), s["u"].alias("u"), s["v"].alias("v"))))
    x0, y0, u0, v0 = (at(at(points, 0), i) for points in (source, target) for i in (0, 1))
    laid = step([turned], lambda s: F.struct(
        s["a"].alias("a"), s["b"].alias("b"), (s["u"] + u0 - s["a"] * (s["x"] + x0) + s["b"] * (s["y"] + y0)).alias("s"), (s["v"] + v0 - s["b"] * (s["x"] + x0) - s["a"] * (s["y"] + y0)).alias("t"),
    ))
    finite = lambda x: F.abs(x) < F.lit(float("inf"))
    out = step([laid], lambda s: F.when(
        F.coalesce(((s["a"] != 0) | (s["b"] != 0)) & finite(s["a"]) & finite(s["b"]) & finite(s["s"]) & finite(s["t"]), F.lit(False)),
        F.array(F.array(s["a"], -s["b"], s["s"]), F.array(s["b"], s["a"], s["t"])),
    ))
    return F.get(out, F.lit(0))
