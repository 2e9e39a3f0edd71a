"""Operator 3: spans, common extensions, edited texts and the order of documents."""

from __future__ import annotations

import hashlib
import random

import xxhash

from recallspark.llm import document_prints as dp
from tests.llm.corpus import frame, rows


def test_spans_and_extensions():
    rng = random.Random(2)
    a = "".join(rng.choice("ab日") for _ in range(300))
    b = a[40:180] + "z" + a[:90]
    x, y = dp.Prefix(dp.points(a)), dp.Prefix(dp.points(b))
    for _ in range(200):
        i, j, n = rng.randrange(250), rng.randrange(180), rng.randrange(40)
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.common(i, y, j) == k


def test_document_prints(spark):
    got = {r["doc_id"]: r for r in dp.document_prints(frame(spark)).collect()}
    order = sorted(rows(), key=lambda r: -r[0])
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)]
        cut = len(text) // 3
        other = text[: len(text) - cut] + (after[1] or "")[:cut]
        mine = got[r[0]]
        assert mine["n_chars"] == len(text) and mine["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert mine["near_next"] == dp.likeness(mine["fingerprint"], got[after[0]]["fingerprint"])
        assert mine["edited_fingerprint"] == dp._print(other)[1] and 0 <= mine["near_edited"] <= 1
        assert (mine["near_edited"] == 1.0) == (mine["fingerprint"] == mine["edited_fingerprint"]) or text != other
    prints: dict[str, set] = {}
    for r in rows():
        prints.setdefault(r[1] or "", set()).add(got[r[0]]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) == len(prints)


def test_empty_single_and_null(spark):
    assert dp.document_prints(frame(spark, [])).count() == 0
    one = dp.document_prints(frame(spark, [(3, "abcdef") + (None,) * 6])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    twice = dp.document_prints(frame(spark, [(None, None) + (None,) * 6] * 2 + [(3, "same") + (None,) * 6] * 2)).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["3", "3", "None", "None"]


def test_rows_of_one_id_are_ordered_by_the_hash_of_their_text(spark):
    texts = [f"text {k} of many without an id " * (k % 5 + 1) for k in range(60)]
    data = [(None if k % 3 else 7, x) + (None,) * 6 for k, x in enumerate(texts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(data, key=lambda r: (r[0] is None, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = set()
    for k, r in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(r[1]) // 3
        want.add((r[0], hashlib.sha256((r[1][: len(r[1]) - cut] + after[:cut]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in dp.document_prints(frame(spark, data)).collect()} == want
