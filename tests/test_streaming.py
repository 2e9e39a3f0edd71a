"""The streaming operator over several micro-batches, against a plain fold."""

from __future__ import annotations

from datetime import UTC, datetime

import duckdb

from recallspark.plans import catalog
from recallspark.sources.shipping import ship
from recallspark.streaming.sequence import encounters
from tests.conftest import same_rows

#: (source, seconds, gap marker); a slot is a second, and the last batch only moves the watermark on.
ROWS = [(s, x, False) for s, slots in (("a", [0, 1, 2, 9, 10, 30]), ("b", [5, 8, 11, 14]), ("c", [1, 50])) for x in slots]
ROWS += [("d", 2, False), ("d", 3, True), ("d", 4, False), ("d", 5, False)]
LAST = [("z", 500, False), ("z", 501, False)]


def closed(max_gap: int) -> list[tuple]:
    out, open_ = [], {}
    for s, x, gap in sorted(ROWS):
        now = open_.pop(s, None)
        if now and (gap or x - now[1] > max_gap):
            out.append((s, *now))
            now = None
        if not gap:
            open_[s] = (now[0], x, now[2] + 1) if now else (x, x, 1)
    return sorted(out + [(s, *now) for s, now in open_.items()])


def test_encounters(spark, tmp_path):
    ship(spark)
    parts = [[r for r in ROWS if lo <= r[1] < hi] for lo, hi in ((0, 6), (6, 12), (12, 99))] + [LAST[:1], LAST[1:]]
    for k, part in enumerate(parts):
        rows = [(s, datetime.fromtimestamp(1000 + x, UTC), g) for s, x, g in part]
        spark.createDataFrame(rows, "source string, ts timestamp, gap boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("source string, ts timestamp, gap boolean, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = encounters(stream.withWatermark("ts", "20 seconds").select("source", "ts", "gap"), "source", "ts", 1.0, 3, "gap")
    query = found.writeStream.format("memory").queryName("met").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination(100)
    got = sorted((r["source"], r["first_slot"] - 1000, r["last_slot"] - 1000, r["seen"]) for r in spark.table("met").collect())
    assert got == closed(3)  # also those that were open when their source fell silent


def test_an_error_in_the_last_slot_closes_as_in_the_sql(spark, tmp_path):
    """Users whose last event shares its minute with an error (before or after it), is followed by none, or goes on."""
    minute = lambda m, s=0: datetime(2024, 1, 5, 10, m, s)
    rows = [(1, minute(50, 1), "error"), (1, minute(50, 9), "view"), (2, minute(51, 1), "view"), (2, minute(51, 9), "error"), (3, minute(52), "view")]
    rows += [(4, minute(50, 1), "error"), (4, minute(50, 9), "view"), (4, minute(51), "view"), (5, minute(50), "error"), (6, datetime(2024, 1, 5, 1), "view"), (7, minute(59), "view")]
    ship(spark)
    spark.createDataFrame([(k, ts.replace(tzinfo=UTC), u, kind) for k, (u, ts, kind) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    found = catalog.queries()["stream_encounters"](spark, str(tmp_path))
    assert {r["user_id"] for r in found.collect()} == {1, 2, 6}
    same_rows(found, con.sql(catalog.oracles()["stream_encounters"]))
