"""The ordered export against a plain loop."""

from __future__ import annotations

from recallspark.operators.relational import first_in_order
from recallspark.plans import catalog
from tests.conftest import SF_DIR


def kept_in_order(rows: list[tuple]) -> list:
    out, seen = [], set()
    for key, a, b in sorted(rows):
        if ("a", a) not in seen and ("b", b) not in seen:
            out.append(key)
            seen |= {("a", a), ("b", b)}
    return out


def test_first_in_order(spark):
    # a chain in which every other row is kept, and groups of many
    rows = [(i, (i + 1) // 2, 100 + i // 2) for i in range(12)] + [(20 + i, i % 3, 100 + i % 7) for i in range(30)]
    frame = spark.createDataFrame(rows, "k long, a long, b long")
    assert sorted(r["k"] for r in first_in_order(frame, "k", "a", "b").collect()) == kept_in_order(rows)
    assert first_in_order(frame.where("k < 0"), "k", "a", "b").count() == 0
    assert first_in_order(spark.createDataFrame([(1, None, 2)], "k long, a long, b long"), "k", "a", "b").count() == 0


def test_verified_export(spark, duck):
    docs = dict(duck.sql("SELECT doc_id, sha256(coalesce(text, '')) FROM documents").fetchall())
    root = {k: k - 3 if k % 10 == 7 and k - 3 in docs else k for k in docs}
    state = {k: "NOT_VERIFIED" if k % 9 == 4 else "FLAGGED" if k % 13 == 5 else None for k in docs}
    kept = set(kept_in_order([(k, root[k], docs[k]) for k in docs if state[k] is None]))
    want = {k: state[k] or ("EXPORTED" if k in kept else "DUPLICATE") for k in docs}
    got = {r["doc_id"]: r["status"] for r in catalog.queries()["verified_export"](spark, SF_DIR).collect()}
    assert got == want and set(want.values()) == {"NOT_VERIFIED", "FLAGGED", "EXPORTED", "DUPLICATE"}
