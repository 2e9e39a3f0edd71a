"""Picture sets: files told apart by digest, samples, near pictures, suggestions, fused results."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.retrieval import best_sums
from recallspark.sources.staging import staged, unstage

#: Prints that meet in one task, scores held at a time, prints of a group that are compared at once.
BUCKET, HELD, FEW = 1 << 20, 1 << 16, 16


def distinct_files(files: DataFrame, order: str, digest: str) -> DataFrame:
    """Each digest once, the first file in order."""
    first = files.groupBy(digest).agg(F.min(F.struct(order, *(c for c in files.columns if c not in (order, digest)))).alias("f"))
    return first.select("f.*", digest)


def enrolment(files: DataFrame, person: str, order: str, digest: str, least: int, count: int) -> DataFrame:
    """(person, order, part): of `count` people (by hash of the name) with at least `least` distinct files,
    the last quarter (one at least) as QUERY, the rest as ENROL."""
    own = distinct_files(files, order, digest)
    many = own.groupBy(person).agg(F.count("*").alias("_many")).where(F.col("_many") >= least)
    chosen = many.orderBy(F.sha2(F.col(person).cast("binary"), 256)).limit(count)
    place = F.row_number().over(Window.partitionBy(person).orderBy(order))
    rows = own.join(chosen, person).withColumn("_place", place)
    asked = F.col("_place") > F.col("_many") - F.greatest(F.lit(1), F.floor(F.col("_many") / 4))
    return rows.select(person, order, F.when(asked, "QUERY").otherwise("ENROL").alias("part"))


def sampled(files: DataFrame, person: str, order: str, digest: str, least: int, people: int, most: int, salt: str = "sample") -> DataFrame:
    """(person, order): the first `people` people, by salted hash of the name, with at least `least` distinct files that
    nobody chosen before them keeps; each keeps the first `most` of these, and those with fewer free all of theirs.

    A person is decided when nobody undecided comes before them at any of their files: all such people are decided in one
    round, over written tables, and a file that many people hold is one row of a minimum.
    """
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(person)).cast("binary"), 256)
    own = files.where(F.col(person).isNotNull()).groupBy(person, digest).agg(F.min(order).alias(order)).withColumn("_key", F.struct(key.alias("hash"), F.col(person).alias("name")))
    left, kept = staged(own, "left"), None
    while not left.isEmpty():
        first = left.groupBy(digest).agg(F.min("_key").alias("_first"))
        sizes = left.join(first, digest).groupBy(person).agg(F.bool_and(F.col("_first") == F.col("_key")).alias("_ready"), F.count("*").alias("_many"))
        ready = staged(sizes.where("_ready"), "ready")
        place = F.row_number().over(Window.partitionBy(person).orderBy(order, digest))
        now = left.join(ready.where(F.col("_many") >= least).select(person), person, "left_semi").withColumn("_place", place).where(F.col("_place") <= most)
        now = staged(now.drop("_place"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        after = staged(left.join(ready, person, "left_anti").join(now.select(digest), digest, "left_anti"), "left")
        unstage(left)
        left = after
    if kept is None:
        return files.select(person, order).limit(0)
    chosen = kept.select(person, "_key").distinct().orderBy("_key").limit(people).select(person)
    return kept.join(chosen, person, "left_semi").select(person, order)


def difference_hash(grey: Column, width: int, height: int) -> Column:
    """A bit for each neighbouring pair of a row of a picture: brighter on the left."""
    place = lambda k: k // (width - 1) * width + k % (width - 1)
    bit = lambda k: (F.get(grey, F.lit(place(k))) > F.get(grey, F.lit(place(k) + 1))).cast("long")
    return reduce(lambda h, k: h.bitwiseOR(F.shiftleft(bit(k), k)), range(1, (width - 1) * height), bit(0))


def band_triples(bands: int) -> list[tuple[int, int, int]]:
    """Triples of bands of which any four bands hold one: three of a third of the bands, or two of it and one of the next."""
    thirds = [range(bands * k // 3, bands * (k + 1) // 3) for k in range(3)]
    inside = [t for some in thirds for t in combinations(some, 3)]
    return inside + [(*two, one) for k in range(3) for two in combinations(thirds[k], 2) for one in thirds[(k + 1) % 3]]


def bands(bits: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, at, to): thirds lo..hi of a print, and bands at..to of each. Of two prints `bits` apart some third differs in
    `bits // 3` places at most, and one of its bands, of which there is one more, in none."""
    cut = lambda lo, hi, n: [lo + (hi - lo) * k // n for k in range(n + 1)]
    thirds = cut(0, 64, 3)
    edges = [(lo, hi, cut(lo, hi, bits // 3 + 1)) for lo, hi in zip(thirds, thirds[1:])]
    return [(lo, hi, at, to) for lo, hi, some in edges for at, to in zip(some, some[1:])]


def _near_places(x: np.ndarray, band: tuple[int, int, int, int], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of prints, equal in a band and near in its third, that are at most `bits` apart.

    They are grouped by so many other bits of the third that a group has `FEW` of them, and a group meets those
    that differ from it in few enough of these."""
    lo, hi, at, to = band
    rest = ((x >> np.uint64(lo)) & np.uint64((1 << (at - lo)) - 1)) | (((x >> np.uint64(min(to, 63))) & np.uint64((1 << (hi - to)) - 1)) << np.uint64(at - lo))
    wide = min(hi - lo - (to - at), max(0, int(np.log2(max(1, len(x) / FEW)))))
    group = (rest & np.uint64((1 << wide) - 1)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    x, first = x[order], np.searchsorted(group[order], np.arange((1 << wide) + 1))
    size = np.diff(first)
    turns = np.flatnonzero(np.bitwise_count(np.arange(1 << wide)) <= bits // 3)
    out = []
    for g in np.flatnonzero(size):
        other = g ^ turns
        other = other[other >= g]  # its own rows too
        n = size[other]
        end = np.cumsum(n)
        near = np.repeat(first[other] - end + n, n) + np.arange(end[-1])
        there = x[near]
        lanes = max(1, HELD // len(near))
        for k in range(first[g], first[g + 1], lanes):
            some = x[k : min(k + lanes, first[g + 1])]
            hit = np.flatnonzero(np.bitwise_count(some[:, None] ^ there) <= bits)
            row, place = k + hit // len(near), near[hit % len(near)]
            pair = row < place
            if pair.any():
                out.append((order[row[pair]], order[place[pair]]))
    return out


def near_bits(prints: DataFrame, bits: int) -> DataFrame:
    """(x, y): prints (bits: each once), x below y, at most `bits` apart.

    Prints that are equal in one of the `bands` meet in a task, once for each band; in it they meet only what is near in the band's
    third. A print travels as often as there are bands (nine for 8 bits). More than `BUCKET` prints are cut into blocks, of
    which every two meet."""
    every = bands(bits)
    value = [F.call_function("shiftrightunsigned", F.col("bits"), F.lit(at)).bitwiseAND((1 << (to - at)) - 1) for _, _, at, to in every]
    keys = prints.select("bits", F.explode(F.array(*(v + F.lit(k << 22) for k, v in enumerate(value)))).alias("key"))
    cut = {}
    if prints.count() > BUCKET:
        large = keys.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).alias("n")).where("n > 1").collect()  # a row for every `BUCKET` keys at most
        cut = {r["key"]: r["n"] | 1 for r in large}
    if cut:
        blocks = prints.sparkSession.createDataFrame(list(cut.items()), "key long, n long")
        n = F.coalesce("n", F.lit(1).cast("long"))
        own = keys.join(F.broadcast(blocks), "key", "left").select("key", "bits", n.alias("n"), F.pmod("bits", n).alias("own"))
        own = own.select("key", "bits", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
        keys = own.select("bits", (F.col("key") * (1 << 32) + F.least("own", "other") * (1 << 16) + F.greatest("own", "other")).alias("key"))
    else:
        keys = keys.select("bits", (F.col("key") * (1 << 32)).alias("key"))

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        packed = key[0].as_py()
        signed = np.asarray(rows["bits"])
        found = _near_places(signed.view(np.uint64), every[packed >> 54], bits)
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        one, two = packed >> 16 & 0xFFFF, packed & 0xFFFF
        if one != two:  # what is within one block meets elsewhere
            own = signed % cut[packed >> 32]
            a, b = a[own[a] != own[b]], b[own[a] != own[b]]
        a, b = signed[a], signed[b]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["x", "y"])

    return keys.groupBy("key").applyInArrow(task, "x long, y long").distinct()


def near_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b): pictures (picture_id, bits: each once), a before b, at most `bits` apart.

    Prints travel without their pictures, which are joined to the pairs found. Neither side is known to be small, so these
    joins are merges: a broadcast would take it all to the driver."""
    x, y = (prints.select(F.col("bits").alias(c), F.col("picture_id").alias(f"_{c}")).hint("merge") for c in "xy")
    met = near_bits(prints, bits).join(x, "x").join(y, "y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def first_of_near(prints: DataFrame, bits: int) -> DataFrame:
    """(picture_id, kept): in order, a picture is kept unless it is within `bits` of one kept before it.

    Only the first picture of a print can be kept: what drops it drops its copies too. Undecided are those with an earlier one
    near them; a round keeps what no undecided earlier picture is near to and drops what is near a kept one; tables between
    rounds are written."""
    own = staged(prints.groupBy("bits").agg(F.min("picture_id").alias("picture_id")), "prints")
    edges = staged(near_pairs(own, bits), "near")
    later = staged(edges.select(F.col("b").alias("picture_id")).distinct(), "later")
    at = lambda some: some.withColumnRenamed("picture_id", "a")
    out = edges.join(at(later), "a", "left_anti").select(F.col("b").alias("picture_id"))
    left = staged(later.join(out, "picture_id", "left_anti"), "left")
    saved = left.where(F.lit(False))
    while not left.isEmpty():
        open_ = edges.join(at(left), "a", "left_semi").select(F.col("b").alias("picture_id"))
        now = staged(left.join(open_, "picture_id", "left_anti"), "first")
        saved = saved.unionByName(now)
        out = edges.join(at(now), "a", "left_semi").select(F.col("b").alias("picture_id"))
        after = staged(left.join(now, "picture_id", "left_anti").join(out, "picture_id", "left_anti"), "left")
        unstage(left)
        left = after
    kept = own.select("picture_id").join(later.join(saved, "picture_id", "left_anti"), "picture_id", "left_anti")
    return prints.select("picture_id").join(kept.withColumn("kept", F.lit(True)), "picture_id", "left").select("picture_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def suggested(asked: DataFrame, faces: DataFrame, floor: float) -> DataFrame:
    """(label, picture, face_id, mean): of the asked faces (face_id, label, picture, vector) of a picture the
    one with the highest mean, over the label's other pictures, of its best similarity there; it must be
    above `floor` and strictly above the next.

    Only faces of one label meet, and a mean is a sum and a number of pictures from each block."""
    fit = best_sums(asked.withColumnRenamed("face_id", "query_id"), faces.select("label", "picture", "vector")).where("n > 0")
    mean = fit.select("label", "picture", F.col("query_id").alias("face_id"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))
    order = Window.partitionBy("label", "picture").orderBy(F.desc("mean"), "face_id")
    top = mean.withColumn("_place", F.row_number().over(order)).withColumn("_next", F.lead("mean").over(order)).where("_place = 1")
    return top.where((F.col("mean") > floor) & (F.col("_next").isNull() | (F.col("mean") > F.col("_next")))).select("label", "picture", "face_id", "mean")


def fused(hits: DataFrame, each: int, depth: int, count: int) -> DataFrame:
    """(type, id, owner, position, provenance): hits (type, id, owner, score) ranked in their type, at most
    `each` of an owner and `depth` of a type, interleaved by rank, `count` in all."""
    mine = F.row_number().over(Window.partitionBy("type", "owner").orderBy(F.desc("score"), "id"))
    some = hits.withColumn("_mine", mine).where(F.col("_mine") <= each)
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "id"))
    top = some.withColumn("_place", place).where(F.col("_place") <= depth).orderBy("_place", "type").limit(count)
    position = F.row_number().over(Window.orderBy("_place", "type"))  # over `count` rows
    return top.select("type", "id", "owner", position.alias("position"), F.concat(F.lit("fused:"), "type").alias("provenance"))
