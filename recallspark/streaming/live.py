"""Live operators with restorable state: a tracker, and encounters with a bounded pool of their best faces.

Both are stateful processors keyed by source. State is what goes on: live tracks (an ended one leaves it), the next
number, faces of a slot that may not be complete yet; or the open encounter and its pool. A timer at the end of the
longest silence ends what nothing continues. `tracker_state` and `open_pools` read the state of a run as a table, which
flushes it at the end of the input, and starts another run where it ended.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recallspark.sources.staging import shared_dir
from recallspark.streaming import sequence
from recallspark.streaming.sequence import Tracks

# Spark starts a process beside the driver that reads the processors and does not get the files shipped to executors.
for _module in (sequence, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FACE = "slot: bigint, id: bigint, box: array<double>, landmarks: array<array<double>>, vector: array<double>"
_TRACK = "slot: bigint, box: array<double>, speed: array<double>, shape: array<array<double>>, face: array<double>, first: bigint, seen: bigint"
_OWN = f"next bigint, last bigint, waiting array<struct<{_FACE}>>"


def _plain(x):
    """Nested lists and numbers of a cell."""
    return None if x is None else [_plain(y) for y in x] if isinstance(x, (list, tuple, np.ndarray)) else float(x)


def _given(x):
    """A nested cell that may still be JSON."""
    return json.loads(x) if isinstance(x, str) else x


class Placing:
    """Faces of a source, placed slot by slot; what is live can be taken out and put in."""

    def __init__(self, min_iou: float, max_gap: int, veto: float, number: int = 0, last: int | None = None, live: dict | None = None):
        self.tracks, self.last, self.span = Tracks(min_iou, max_gap, veto), last, {}
        t, live = self.tracks, dict(sorted((live or {}).items()))
        t.begun = number
        if live:
            t.number, t.slot = np.array(list(live), np.int64), np.array([x[0] for x in live.values()], np.int64)
            t.box, t.speed = (np.array([x[k] for x in live.values()], float).reshape(-1, 4) for k in (1, 2))
            t.shape = [None if x[3] is None else np.array(x[3], float) for x in live.values()]
            t.face = [x[4] for x in live.values()]
            self.span = {n: (x[5], x[6]) for n, x in live.items()}

    def place(self, faces: list[tuple]) -> list[tuple]:
        """(slot, id, track) of faces (slot, id, box, landmarks, vector) in order; NULL for those behind the last slot.

        Landmarks and vectors may be JSON, which takes a fraction of the memory: those of one slot are read at a time."""
        out, at = [], 0
        while at < len(faces):
            now, stop = faces[at][0], at
            while stop < len(faces) and faces[stop][0] == now:
                stop += 1
            some = faces[at:stop]
            at = stop
            if self.last is not None and now <= self.last:
                out += [(now, f[1], None) for f in some]
                continue
            real = [(*f[:3], *map(_given, f[3:])) for f in some if f[2] is not None]
            if real:
                numbers = self.tracks.place(now, np.array([f[2] for f in real], float), [None if f[3] is None else np.array(f[3], float) for f in real], [f[4] for f in real])
                for f, n in zip(real, numbers.tolist()):
                    first, seen = self.span.get(n, (now, 0))
                    self.span[n] = first, seen + 1
                    out.append((now, f[1], n))
            self.last = now
        return out

    def live(self, now: int) -> dict:
        """What goes on after slot `now`."""
        t = self.tracks
        t.keep(now - t.slot <= t.max_gap)
        self.span = {n: self.span[n] for n in t.number.tolist()}
        return {
            n: (int(s), b.tolist(), v.tolist(), _plain(m), _plain(f), *map(int, self.span[n]))
            for n, s, b, v, m, f in zip(t.number.tolist(), t.slot, t.box, t.speed, t.shape, t.face)
        }


class Tracking(StatefulProcessor):
    """Rows (source, slot, id, x0, y0, x1, y1, landmarks, vector) -> (source, slot, id, track)."""

    def __init__(self, source: str, min_iou: float, max_gap: int, veto: float, rate: float):
        self.source, self.rule, self.max_gap, self.rate = source, (min_iou, max_gap, veto), max_gap, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", _OWN)
        self.live = handle.getMapState("live", "track bigint", _TRACK.replace(":", ""))

    def _placing(self) -> tuple[Placing, list]:
        number, last, waiting = self.own.get() if self.own.exists() else (0, None, [])
        live = {k[0]: tuple(_plain(x) if isinstance(x, (list, np.ndarray)) else x for x in v) for k, v in self.live.iterator()}
        return Placing(*self.rule, number, last, live), [(f[0], f[1], _plain(f[2]), _plain(f[3]), _plain(f[4])) for f in waiting or []]

    def _keep(self, placing: Placing, waiting: list, now: int) -> None:
        was = {k[0] for k in self.live.keys()}
        live = placing.live(now)
        for n in was - set(live):
            self.live.removeKey((n,))
        for n, x in live.items():
            self.live.updateValue((n,), x)
        self.own.update((placing.tracks.begun, placing.last, waiting))

    def _rows(self, key: tuple, placed: list) -> pd.DataFrame:
        out = pd.DataFrame(placed, columns=["slot", "id", "track"])
        out.insert(0, self.source, [key[0]] * len(out))
        return out.astype({"track": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        placing, faces = self._placing()
        for part in rows:
            box = part[["x0", "y0", "x1", "y1"]].to_numpy(float)
            marks, vectors = ([x or None for x in part[c]] if c in part else [None] * len(part) for c in ("landmarks", "vector"))
            faces += [(int(s), int(i), None if np.isnan(b).any() else b.tolist(), m, v) for s, i, b, m, v in zip(part["slot"], part["id"].fillna(-1), box, marks, vectors)]
        faces.sort(key=lambda f: f[:2])
        newest = faces[-1][0]
        behind = placing.last is not None and newest <= placing.last
        done = [f for f in faces if f[0] < newest or behind]
        waiting = [] if behind else [(*f[:3], *map(_given, f[3:])) for f in faces if f[0] == newest]  # the slot may go on in the next batch
        placed = placing.place(done)
        last = max(x for x in (placing.last, newest) if x is not None)
        self._keep(placing, waiting, last)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.max_gap + 1) / self.rate * 1000))
        if placed:
            yield self._rows(key, placed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        placing, waiting = self._placing()
        placed = placing.place(waiting)
        self._keep(placing, [], 1 << 62)  # nothing goes on
        if placed:
            yield self._rows(key, placed)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        faces = [(f["slot"], f["id"], f.get("box"), f.get("landmarks"), f.get("vector")) for f in json.loads(row["waiting"])]
        last = None if pd.isna(row["last"]) else int(row["last"])
        self.own.update((int(row["next"]), last, faces))
        for t in json.loads(row["live"]):
            self.live.updateValue((t["track"],), (t["slot"], t["box"], t["speed"], t.get("shape"), t.get("face"), t["first"], t["seen"]))

    def close(self) -> None:
        pass


def track_stream(rows: DataFrame, source: str, rate: float, min_iou: float = 0.2, max_gap: int = 2, veto: float = 0.2, state: DataFrame | None = None) -> DataFrame:
    """(source, slot, id, track): the tracks of `track_boxes` for a stream of its rows with a watermark, slots of a
    source in order and `rate` slots a second. `state` (of `tracker_state`) goes on where another run ended.

    A slot is placed when a later one, or the watermark, has passed it, so batches may cut it. Rows without a
    box only say that a slot was seen; rows behind the last placed slot get no track.
    """
    kind = rows.schema[source].dataType.simpleString()
    # nested columns travel as JSON, which keeps every bit of a double: Arrow's lists of lists do not reach a processor
    nested = [F.to_json(c).alias(c) for c in ("landmarks", "vector") if c in rows.columns]
    columns = [source, "slot", "id", "x0", "y0", "x1", "y1", *nested, *(c for c in ("ts",) if c in rows.columns)]
    start = None if state is None else state.select(source, "next", "last", F.to_json("waiting").alias("waiting"), F.to_json("live").alias("live")).groupBy(source)
    processor = Tracking(source, min_iou, max_gap, veto, rate)
    return rows.select(*columns).groupBy(source).transformWithStateInPandas(
        processor, f"{source} {kind}, slot bigint, id bigint, track bigint", "Append", "EventTime", initialState=start
    )


def tracker_state(spark: SparkSession, checkpoint: str, source: str) -> DataFrame:
    """(source, next, last, waiting, live): the tracker's state at a checkpoint, a row a source."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    own = read("own").select(F.col(f"key.{source}").alias(source), "value.*")
    live = read("live").select(F.col(f"key.{source}").alias(source), F.struct(F.col("user_map_key.track").alias("track"), "user_map_value.*").alias("t"))
    live = live.groupBy(source).agg(F.sort_array(F.collect_list("t")).alias("live"))
    empty = F.array().cast(live.schema["live"].dataType)
    return own.join(live, source, "left").select(source, "next", "last", "waiting", F.coalesce("live", empty).alias("live"))


#: Sources whose state a task unfolds at a time.
SOURCES = 256


def placed_at_the_end(state: DataFrame, source: str, min_iou: float = 0.2, max_gap: int = 2, veto: float = 0.2) -> DataFrame:
    """(source, slot, id, track) of the faces that still wait in a state."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(source).type, *[pa.int64()] * 3]
            for at in range(0, batch.num_rows, SOURCES):
                out = []
                for r in batch.slice(at, SOURCES).to_pylist():
                    tracks = {t["track"]: (t["slot"], _plain(t["box"]), _plain(t["speed"]), _plain(t["shape"]), _plain(t["face"]), t["first"], t["seen"]) for t in r["live"]}
                    placing = Placing(min_iou, max_gap, veto, r["next"], r["last"], tracks)
                    faces = [(f["slot"], f["id"], _plain(f["box"]), _plain(f["landmarks"]), _plain(f["vector"])) for f in r["waiting"]]
                    out += [(r[source], *x) for x in placing.place(faces)]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[source, "slot", "id", "track"])

    kind = state.schema[source].dataType.simpleString()
    return state.mapInArrow(task, f"{source} {kind}, slot bigint, id bigint, track bigint")


_POOL = "array<struct<merit: double, slot: bigint, id: bigint>>"


def pooled(pool: list[tuple], face: tuple, most: int) -> list[tuple]:
    """A pool of (merit, slot, id) with one face more: a full one gives up its worst, the first of several, for a strictly
    better face only."""
    if len(pool) < most:
        return [*pool, face]
    worst = min(range(len(pool)), key=lambda k: pool[k][0])
    return [*pool[:worst], *pool[worst + 1 :], face] if face[0] > pool[worst][0] else pool


class Pools(StatefulProcessor):
    """Rows (source, slot, id, merit, gap) -> encounters (source, first_slot, last_slot, seen, pool)."""

    def __init__(self, source: str, max_gap: int, rate: float, most: int):
        self.source, self.max_gap, self.rate, self.most = source, max_gap, rate, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"first_slot bigint, last_slot bigint, seen bigint, pool {_POOL}")

    def _rows(self, key: tuple, closed: list) -> pd.DataFrame:
        out = pd.DataFrame(closed, columns=["first_slot", "last_slot", "seen", "pool"])
        out["pool"] = [[{"merit": m, "slot": s, "id": i} for m, s, i in p] for p in out["pool"]]
        out.insert(0, self.source, [key[0]] * len(out))
        return out

    def _now(self) -> tuple | None:
        if not self.open.exists():
            return None
        first, last, seen, pool = self.open.get()
        return first, last, seen, [tuple(x) for x in pool]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, closed, seen = self._now(), [], []
        for part in rows:
            seen += [(int(s), not g, int(i), float(m)) for s, g, i, m in zip(part["slot"], part["gap"], part["id"], part["merit"])]
        for slot, real, face, merit in sorted(seen):
            if now is not None and (not real or slot - now[1] > self.max_gap):
                closed.append(now)
                now = None
            if real:
                first, last, n, pool = now or (slot, slot, 0, [])
                now = min(first, slot), max(last, slot), n + 1, pooled(pool, (merit, slot, face), self.most)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            self.handle.registerTimer(int((now[1] + self.max_gap + 1) / self.rate * 1000))
        if closed:
            yield self._rows(key, closed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now()
        self.open.clear()
        if now is not None:
            yield self._rows(key, [now])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        pool = [(float(x["merit"]), x["slot"], x["id"]) for x in json.loads(row["pool"])]
        self.open.update((int(row["first_slot"]), int(row["last_slot"]), int(row["seen"]), pool))
        self.handle.registerTimer(int((int(row["last_slot"]) + self.max_gap + 1) / self.rate * 1000))

    def close(self) -> None:
        pass


def pooled_encounters(rows: DataFrame, source: str, max_gap: int, rate: float, most: int = 8, state: DataFrame | None = None) -> DataFrame:
    """(source, first_slot, last_slot, seen, pool): encounters of a stream (source, slot, id, merit, gap) with a
    watermark, as they close: by a silence of more than max_gap slots, a row marked `gap` or the watermark.

    `pool` holds the `most` best faces by merit, as a fold over rows in order of slot and id keeps them. `state` (of
    `open_pools`) goes on with the encounters another run left open.
    """
    kind = rows.schema[source].dataType.simpleString()
    start = None if state is None else state.select(source, "first_slot", "last_slot", "seen", F.to_json("pool").alias("pool")).groupBy(source)
    columns = [source, "slot", "id", "merit", "gap", *(c for c in ("ts",) if c in rows.columns)]
    return rows.select(*columns).groupBy(source).transformWithStateInPandas(
        Pools(source, max_gap, rate, most), f"{source} {kind}, first_slot bigint, last_slot bigint, seen bigint, pool {_POOL}", "Append", "EventTime", initialState=start
    )


def open_pools(spark: SparkSession, checkpoint: str, source: str) -> DataFrame:
    """(source, first_slot, last_slot, seen, pool) of the encounters that are open at a checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return rows.select(F.col(f"key.{source}").alias(source), "value.*")


def run(stream: DataFrame, name: str, where: str | None = None) -> tuple[DataFrame, str]:
    """What a stream gives for all that its source holds now, as a table, and its checkpoint. With `where` (a folder of
    an earlier run), that run goes on."""
    spark = stream.sparkSession
    where = where or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/rows")
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{where}/rows"), f"{where}/state"
