"""Operator 5: fingerprints, the Golay code, links against all pairs, classes."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from recallspark.llm import simhash
from tests.llm.corpus import WORD, frame, rows


def plain_fingerprint(text: str | None) -> int:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(raw)
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints: dict[int, int], bits: int) -> dict[int, int]:
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in prints}


def test_golay_decoding():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.codeword_index(words)
    for flips in ((), (3,), (0, 22)):
        other = words ^ sum(1 << f for f in flips)
        a, b = simhash.codeword_indices(words), simhash.codeword_indices(other)
        assert all({*x[x >= 0]} & {*y[y >= 0]} for x, y in zip(a, b))  # within two bits an index is shared
    assert (simhash.codeword_indices(words) == index[:, None]).any(axis=1).all()


def test_near_duplicates(spark):
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows()}
    classes = plain_classes(prints, 4)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(frame(spark)).collect()}
    assert got == {d: (prints[d], classes[d]) for d in prints}
    assert {r["doc_id"] for r in simhash.one_of_each(frame(spark)).collect()} == set(classes.values())


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_lose_none(spark, monkeypatch, bucket):
    """Chains of fingerprints at 1 to 5 bits, also when keys are compared in blocks."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    found = {rng.getrandbits(64) for _ in range(150)}
    for x in list(found):
        for _ in range(rng.randint(0, 4)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            found.add(x)
    same = rng.getrandbits(64)
    found |= {same ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}  # one dense key
    prints = dict(enumerate(sorted(found)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints.values()], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    number = {x: d for d, x in prints.items()}
    up = dict.fromkeys(prints)
    forest = simhash.Forest()
    for a, b in links:
        forest.join(number[a], number[b])
    assert {d: forest.root(d) for d in up} == plain_classes(prints, 4)


def test_empty_and_null(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    out = simhash.near_duplicates(frame(spark, [(None, None) + (None,) * 6, (4, "", "", "", 0, 0, "", ""), (4, "", "", "", 0, 0, "", "")])).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == [("4", "0" * 16, 4), ("4", "0" * 16, 4), ("None", "0" * 16, 4)]
