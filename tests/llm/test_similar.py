"""Near duplicates by similarity 0.8 of five-word shingles, against all pairs."""

from __future__ import annotations

import random

import pytest

from recallspark.llm import similar
from tests.llm.corpus import frame


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain_groups(texts: list) -> list[int]:
    """The first member of each text's group."""
    sets, up = [shingles(x) for x in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both >= 0.8 * (len(a) + len(sets[j]) - both) and both:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(x) for x in range(len(texts))]


def corpus(seed: int = 11) -> list:
    """Texts with copies and copies of copies at 0 to 12 changed words, and a dense group of near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out: list = [None, "", " ", "one", "One", "two words"]

    def changed(text: str, n: int) -> str:
        words = text.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    for _ in range(60):
        x = " ".join(word() for _ in range(rng.randint(40, 300)))
        out.append(x)
        for _ in range(rng.randint(0, 4)):
            x = changed(x, rng.randint(0, 12))
            out.append(x)
    base = " ".join(word() for _ in range(200))
    out += [changed(base, rng.randint(1, 5)) for _ in range(60)]
    return out


@pytest.mark.parametrize(("bucket", "group"), [(1024, 1024), (8, 8)])
def test_groups(spark, monkeypatch, bucket, group):
    """Every pair of the groups is found, also when keys and classes are compared in blocks."""
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "CLASS", group)
    texts = corpus()
    got = {r["did"]: r["component"] for r in similar.groups(frame(spark, [(i, x, *(None,) * 6) for i, x in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)


def test_edges(spark):
    assert similar.one_of_each(frame(spark, [])).count() == 0
    data = [(4, "", "", "", 0, 0, "", "")] * 2 + [(None, None) + (None,) * 6, (3, "a b", "", "", 0, 0, "x", "y")]
    out = similar.one_of_each(frame(spark, data))
    assert out.columns == frame(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(3, "a b"), (4, "")]
