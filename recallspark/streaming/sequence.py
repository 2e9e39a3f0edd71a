"""Ordered operators over timed detections: sampling, sessions, tracking, selection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallspark.sources.staging import shared_dir, staged


def slot(ts: Column, rate: float) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1e6 * rate)


def slot_sample(frames: DataFrame, source: str, ts: str, rate: float, key: str) -> DataFrame:
    """First frame of each slot of each source."""
    rows = frames.withColumn("slot", slot(F.col(ts), rate))
    at = Window.partitionBy(source, "slot").orderBy(ts, key)
    return rows.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def gap_sessions(rows: DataFrame, source: str, slot_column: str, key: str, max_gap: int, gap: Column | None = None) -> DataFrame:
    """Rows with their session number: a silence of more than max_gap slots, or a gap marker, closes it."""
    order = Window.partitionBy(source).orderBy(slot_column, key)
    before = F.lag(slot_column).over(order)
    new = before.isNull() | (F.col(slot_column) - before > max_gap)
    if gap is not None:
        new = new | gap
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(order)).drop("_new")


#: Pairs of a live track and a box up to which they are compared one by one.
FEW = 32


class Tracks:
    """Live tracks of one session, as parallel arrays: where each was last seen and how it moved."""

    def __init__(self, min_iou: float, max_gap: int, veto: float):
        self.min_iou, self.max_gap, self.veto = min_iou, max_gap, veto
        self.number = self.slot = np.zeros(0, np.int64)
        self.box = self.speed = np.zeros((0, 4))
        self.shape: list = []
        self.face: list = []
        self.begun = 0

    def fits(self, now: int, boxes: np.ndarray, shapes: list, faces: list) -> np.ndarray:
        """Rows (fit, live track, box) of what may go together, best fit first."""
        guess = self.box + self.speed * (now - self.slot)[:, None]
        fit = overlaps(guess, boxes)
        for t, b in np.argwhere(fit >= self.min_iou):
            fit[t, b] *= agreement(self.shape[t], shapes[b])
            if alike(self.face[t], faces[b]) < self.veto:
                fit[t, b] = -1.0
        t, b = np.nonzero(fit >= self.min_iou)
        if not len(t):
            return np.zeros((0, 3))
        return np.stack([fit[t, b], t, b], axis=1)[np.lexsort((b, t, -fit[t, b]))]

    def few(self, now: int, boxes: np.ndarray, shapes: list, faces: list) -> list[tuple]:
        """`fits` number by number, which is faster for the few tracks and boxes of a usual slot; the same operations in the same order."""
        out, others = [], boxes.tolist()
        for t, (box, speed, slot) in enumerate(zip(self.box.tolist(), self.speed.tolist(), self.slot.tolist())):
            gap = now - slot
            left, top, right, bottom = (x + v * gap for x, v in zip(box, speed))
            area = (right - left) * (bottom - top)
            for b, (x0, y0, x1, y1) in enumerate(others):
                both = max(min(right, x1) - max(left, x0), 0.0) * max(min(bottom, y1) - max(top, y0), 0.0)
                union = area + (x1 - x0) * (y1 - y0) - both
                fit = both / union if union > 0 else 0.0
                if fit >= self.min_iou:
                    fit = fit * agreement(self.shape[t], shapes[b]) if alike(self.face[t], faces[b]) >= self.veto else -1.0
                    if fit >= self.min_iou:
                        out.append((-fit, t, b))
        return sorted(out)

    def place(self, now: int, boxes: np.ndarray, shapes: list, faces: list) -> np.ndarray:
        """Track numbers of the boxes of a slot."""
        alive = now - self.slot <= self.max_gap
        if not alive.all():
            self.keep(alive)
        to = np.full(len(boxes), -1)
        used: set[int] = set()
        for _, t, b in (self.few if len(self.number) * len(boxes) <= FEW else self.fits)(now, boxes, shapes, faces):
            t, b = int(t), int(b)
            if t not in used and to[b] < 0:
                used.add(t)
                to[b] = t
        old, fresh = np.flatnonzero(to >= 0), np.flatnonzero(to < 0)
        out = np.empty(len(boxes), np.int64)
        if len(old):
            at = to[old]
            out[old] = self.number[at]
            self.speed[at] = (boxes[old] - self.box[at]) / np.maximum(now - self.slot[at], 1)[:, None]
            self.box[at], self.slot[at] = boxes[old], now
            for t, b in zip(at.tolist(), old.tolist()):
                self.shape[t], self.face[t] = shapes[b], faces[b]
        if len(fresh):
            out[fresh] = self.begun + np.arange(len(fresh))
            self.begun += len(fresh)
            self.number, self.slot = np.concatenate([self.number, out[fresh]]), np.concatenate([self.slot, np.full(len(fresh), now)])
            self.box, self.speed = np.concatenate([self.box, boxes[fresh]]), np.concatenate([self.speed, np.zeros((len(fresh), 4))])
            self.shape += [shapes[b] for b in fresh]
            self.face += [faces[b] for b in fresh]
        return out

    def keep(self, alive: np.ndarray) -> None:
        self.number, self.slot, self.box, self.speed = self.number[alive], self.slot[alive], self.box[alive], self.speed[alive]
        self.shape, self.face = ([x for x, on in zip(some, alive) if on] for some in (self.shape, self.face))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of `a` with every one of `b`."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.clip(high - low, 0, None), axis=2)
    union = np.prod(a[:, 2:] - a[:, :2], axis=1)[:, None] + np.prod(b[:, 2:] - b[:, :2], axis=1)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(union), where=union > 0)


def agreement(a, b) -> float:
    """1 for equal shapes (points in box coordinates) down to 0 at a mean distance of 0.5; 1 if one is missing."""
    if a is None or b is None:
        return 1.0
    apart = np.hypot(*(np.asarray(a) - np.asarray(b)).T)
    return max(0.0, 1.0 - float(np.add.reduce(apart)) / len(apart) / 0.5)


def alike(a, b) -> float:
    """Cosine of two face vectors; 1 if one is missing."""
    if a is None or b is None:
        return 1.0
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / size if size > 0 else 1.0


def _arrays(column: pa.ListArray) -> list:
    """The numbers of each row's list; None where it is missing."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:b] if on else None for a, b, on in zip(at, at[1:], column.is_valid().to_pylist())]


def _points(column: pa.ListArray) -> list:
    """The points of each row as rows of an array; None where they are missing."""
    flat, inner, at = column.values.values.to_numpy(zero_copy_only=False).astype(float), column.values.offsets.to_numpy(), column.offsets.to_pylist()
    return [flat[inner[a] : inner[b]].reshape(b - a, -1) if on else None for a, b, on in zip(at, at[1:], column.is_valid().to_pylist())]


def track_boxes(rows: DataFrame, source: str, min_iou: float = 0.2, max_gap: int = 2, veto: float = 0.2) -> DataFrame:
    """Rows (source, slot, id, x0, y0, x1, y1) with `track`: in each slot, boxes continue the live
    tracks that they fit best (moved on at their last speed), best first; the rest begin new tracks.
    A fit is the overlap times the agreement of `landmarks` (in box coordinates), and a track is not
    continued by a face whose `vector` has a cosine below `veto` to its last one; both columns are optional.

    A silence of more than max_gap slots ends all tracks, so a source falls into sessions that tasks
    take separately. A session is read in order from a sorted partition: a task holds the live tracks
    and one slot, whatever its length. Numbers count on through a source.
    """
    names = [c for c in ("landmarks", "vector") if c in rows.columns]
    sessions = gap_sessions(rows, source, "slot", "id", max_gap)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, rest = None, Tracks(min_iou, max_gap, veto), None

        def placed(part: pa.RecordBatch, keys: list) -> pa.RecordBatch:
            nonlocal key, live
            box = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
            marks = _points(part.column("landmarks")) if "landmarks" in names else [None] * len(keys)
            faces = _arrays(part.column("vector")) if "vector" in names else [None] * len(keys)
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            out = np.zeros(len(keys), np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo][:2] != key:
                    key, live = keys[lo][:2], Tracks(min_iou, max_gap, veto)
                out[lo:hi] = live.place(int(keys[lo][2]), box[lo:hi], marks[lo:hi], faces[lo:hi])
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, "track"])

        for part in parts:
            if rest is not None:
                part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
            keys = list(zip(*(part.column(c).to_pylist() for c in (source, "session", "slot"))))
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            if last:
                yield placed(part.slice(0, last), keys[:last])
            rest = part.slice(last) if len(keys) else None  # the last slot may go on in the next batch
        if rest is not None:
            yield placed(rest, list(zip(*(rest.column(c).to_pylist() for c in (source, "session", "slot")))))

    schema = T.StructType([*sessions.schema.fields, T.StructField("track", T.LongType())])
    found = staged(sessions.repartition(source, "session").sortWithinPartitions(source, "session", "slot", "id").mapInArrow(task, schema), "tracked")
    many = found.groupBy(source, "session").agg((F.max("track") + 1).alias("_n"))
    before = Window.partitionBy(source).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    base = many.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = found.join(base, [source, "session"]).withColumn("track", F.col("track") + F.col("_base"))
    return out.select(*rows.columns, "track")


def select_kept(rows: DataFrame, track: Sequence[str], keep: int, min_score: float, min_gap: int = 2, chunk: str | None = None, lifetime: int | None = None) -> DataFrame:
    """Best faces of each track (score, merit, slot, id; one row a slot): good ones at least `min_gap`
    slots apart in the order of merit, then more good ones until `keep`; the best alone if none is good.
    With `chunk`, so many of each chunk of a track, and of these the first `lifetime` of the track.

    Every face kept keeps others from at most 2 * (min_gap - 1) slots, so a number of best rows that
    depends on the parameters alone decides; only these are put into an array.
    """
    keys = [*track, *([chunk] if chunk else [])]
    enough = 1 + (keep - 1) * (1 + 2 * (min_gap - 1)) + keep
    good = F.col("score") >= min_score
    order = Window.partitionBy(*keys).orderBy(F.desc("_good"), F.desc("merit"), "id")
    best = rows.withColumn("_good", good).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= enough)
    some = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", "_good", F.struct(*rows.columns).alias("row")))).alias("all"))
    fine = F.filter("all", lambda x: x["_good"])
    none = F.slice(fine, 1, 0)
    room = lambda kept: F.size(kept) < keep
    apart = lambda kept, x: F.forall(kept, lambda k: F.abs(k["row"]["slot"] - x["row"]["slot"]) >= min_gap)
    spread = F.aggregate("fine", none, lambda kept, x: F.when(room(kept) & apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    filled = F.aggregate("fine", F.col("spread"), lambda kept, x: F.when(room(kept) & ~F.exists(kept, lambda k: k["_rank"] == x["_rank"]), F.concat(kept, F.array(x))).otherwise(kept))
    picked = some.withColumn("fine", fine).withColumn("spread", spread).withColumn("filled", F.when(F.size("fine") == 0, F.slice("all", 1, min(keep, 1))).otherwise(filled))
    out = picked.select(*keys, F.posexplode("filled").alias("_at", "x")).select(*keys, "_at", "x.row")
    if lifetime is not None:
        life = Window.partitionBy(*track).orderBy(*([chunk] if chunk else []), "_at")
        out = out.withColumn("_n", F.row_number().over(life)).where(F.col("_n") <= lifetime)
    return out.select("row.*")


def encounters(stream: DataFrame, source: str, ts: str, rate: float, max_gap: int, gap: str | None = None) -> DataFrame:
    """Closed encounters (source, first_slot, last_slot, seen) of a stream (source, ts) with a watermark
    on `ts`; an encounter ends at a silence of more than max_gap slots or at a row marked `gap`. Of one
    slot gaps come first; one that is left in the last slot that holds a gap, or before it, ends when the
    watermark moves, unless more rows have come.

    State is one row a source with an open encounter, or with a gap that the watermark has not passed. When
    the watermark has passed the longest silence the encounter is emitted and the state dropped; rows
    behind the watermark are dropped by Spark.
    """
    rows = stream.select(source, ts, slot(F.col(ts), rate).alias("slot"), (F.col(gap) if gap else F.lit(False)).alias("gap"))
    never = -(1 << 62)

    def closing(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        *held, cut = state.get if state.exists else (0, 0, 0, never)
        open_ = tuple(held) if held[2] else None
        if state.hasTimedOut:
            if open_ is not None:
                out.append((key[0], *open_))
            state.remove()
        else:
            seen = sorted((x, not g) for part in parts for x, g in zip(part["slot"].tolist(), part["gap"].tolist()))
            for x, real in seen:
                if open_ is not None and (not real or x - open_[1] > max_gap):
                    out.append((key[0], *open_))
                    open_ = None
                if real:
                    open_ = (x, x, 1) if open_ is None else (min(x, open_[0]), max(x, open_[1]), open_[2] + 1)
                else:
                    cut = max(cut, x)
            if open_ is None and cut == never:
                state.remove() if state.exists else None
            else:
                state.update((*(open_ or (0, 0, 0)), cut))
                until = cut + 1 if open_ is None else open_[1] + max_gap + 1 if cut < open_[1] else 0
                state.setTimeoutTimestamp(max(round(until / rate * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[source, "first_slot", "last_slot", "seen"])

    kind = stream.schema[source].dataType.simpleString()
    return rows.groupBy(source).applyInPandasWithState(
        closing, f"{source} {kind}, first_slot long, last_slot long, seen long", "first long, last long, seen long, cut long", "append", GroupStateTimeout.EventTimeTimeout
    )


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source holds now: run to the end into a table of the shared folder."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
