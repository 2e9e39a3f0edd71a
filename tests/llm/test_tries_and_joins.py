"""Prefix tries, Jaccard joins and filter audits against plain loops, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from recallspark.llm import filter_audit, prefix_trie, token_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows) -> Counter:
    """Nodes of (conv_id, turn, role, text) rows by plain loops."""
    own = defaultdict(list)
    name = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, name(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in paths.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for t in members:
        if t:
            children[t[:-1]] += 1
    for t, m in members.items():
        worth = (len(m) - 1) * len(WORD.findall(t[-1][1])) if t else 0
        for d in range(len(t) + 1):
            leaves[t[:d]] += children[t] == 0
            saved[t[:d]] += worth
    sha = lambda m, t: hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == t).encode()).hexdigest()
    return Counter((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), children[t], leaves[t], saved[t], sha(m, t)) for t, m in members.items())


def trie_rows(case: str) -> list[tuple]:
    rng = random.Random(3)
    say = lambda: (rng.choice(["user", "assistant", None]), " ".join(rng.choice("a b c dé".split()) for _ in range(rng.randint(0, 4))) or None)
    if case == "small":
        rows = [(c, t if t else rng.choice([0, None]), *say()) for c in range(-45, 130) if c % 7 for t in range(rng.randint(1, 5))]
        rows += [(None, 0, "user", "nobody"), (500, 1, "user", "one"), (500, 1, "user", "two"), (500, 1, "user", "one"), (501, 2, "u", ""), (502, None, None, None)]
        return rows + rows[:3]
    if case == "deep":  # copies of one deep conversation, a deep one of its own, and short ones
        long = [say() for _ in range(130)]
        return [(c, t, *x) for c in (40, 41, 60, 63, 77) for t, x in enumerate(long[: 130 - c // 20])] + [(c, t, *say()) for c in range(90, 99) for t in range(3)]
    # one conversation holds nearly all rows, so that it lies in every range, and so does its base's other taker
    return [(c, t, "user", f"turn {t}") for c in (20, 23) for t in range(900)] + [(c, t, *say()) for c in range(30) if c not in (20, 23) for t in range(2)]


@pytest.mark.parametrize("case", ["small", "deep", "hot"])
def test_prefix_trie(spark, case):
    rows = trie_rows(case)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, depth int").repartition(6)
    out = prefix_trie.prefix_trie(docs)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in out.select(columns).collect()) == plain_trie(rows)
    assert out.where("parent_id is not null").select("parent_id").distinct().join(out.selectExpr("node_id as parent_id"), "parent_id", "left_anti").isEmpty()


def test_prefix_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).isEmpty()
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).isEmpty()


def test_blocks_and_pieces_do_not_change_a_trie(monkeypatch):
    """Tables flushed at every batch and lists of two ids give the nodes and digests of larger ones."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 300
    sums = [rng.integers(0, 9, n).astype(np.uint64) for _ in range(2)]
    terms = [rng.integers(0, 9, n).astype(np.uint64) for _ in range(2)]
    seen = []
    for most in (1, 1 << 18):
        monkeypatch.setattr(prefix_trie, "BLOCK", most)
        table, out = prefix_trie.Partial(), Counter()
        parts = [b for a in range(0, n, 50) for b in table.add([s[a : a + 50] for s in sums], [t[a : a + 50] for t in terms], np.ones(50, np.int64), np.ones(50, np.int64), np.arange(a, a + 50), np.arange(50) % 3 == 0)]
        for b in parts + list(table.emit()):
            for k1, k2, members, ends in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "members", "ends"))):
                out[k1, k2] += members
                for x in np.frombuffer(ends, np.int64).tolist():
                    out["end", k1, k2, x] += 1
        seen.append(out)
    assert seen[0] == seen[1] and sum(v for k, v in seen[0].items() if k[0] != "end") == n
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5 + [2], pa.int64()), pa.array([7] * 6, pa.int64()), pa.array([3, 5, 8, 11, 12, -4], pa.int64())], names=["k1", "k2", "conv"])
    for most in (2, 1 << 16):
        monkeypatch.setattr(prefix_trie, "PIECE", most)
        pieces = [b.select(["k1", "k2", "ends"]) for b in prefix_trie._pieces([batch])]
        got = [tuple(r.values()) for b in prefix_trie._digests(pieces) for r in b.to_pylist()]
        assert got == [(1, 7, hashlib.sha256(b"3,5,8,11,12").hexdigest()), (2, 7, hashlib.sha256(b"-4").hexdigest())]


def near_texts(seed: int = 1) -> list[tuple]:
    """Families of near copies around the limit, a chain, small sets, one passage in many texts, and awkward rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**5)}"
    out = []
    for size in (11, 12, 13, 20, 40, 90, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            out.append(" ".join(text))
    chain = [word() for _ in range(160)]
    for k in range(12):
        chain[10 * k : 10 * k + 2] = [word(), word()]
        out.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    out += [" ".join([word() for _ in range(rng.randint(1, 9))] + passage + [word() for _ in range(rng.randint(3, 30))]) for _ in range(30)]
    out += [None, None, "", " \t", "one", "ONE", "one two", "two one", "a b c", "A b\tC", "a b c a b c", out[5].upper(), out[5]]
    rows = [(k, x) for k, x in enumerate(out)]
    rng.shuffle(rows)
    return [*rows, (None, out[5]), (None, out[20]), (None, None), (7, out[40]), (3, out[60]), (3, out[60]), (None, "alone in the world"), (None, "alone in the world")]


def plain_components(rows) -> Counter:
    lower = {k: k + 32 for k in range(65, 91)}
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 90 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    least = {}
    for (did, _), x in zip(rows, label):
        least[x] = min(least.get(x, 1 << 70), (1 << 63) if did is None else did)
    return Counter((did, len(s), None if least[x] == 1 << 63 else least[x]) for (did, _), s, x in zip(rows, sets, label))


@pytest.mark.parametrize("limits", [{}, {"most_tokens": 600, "most_sets": 6}])
def test_jaccard_join(spark, limits):
    """All links, and none else: classes in one go, and classes cut into blocks."""
    rows = near_texts()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, did string, component string").repartition(5)
    got = token_groups.jaccard_join(docs, **limits)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows)


def test_jaccard_join_of_nothing(spark):
    assert token_groups.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_linked_sets_agree_in_a_part():
    """Sets at the limit of similarity share a key, at all sizes around the bounds of size classes."""
    rng = np.random.default_rng(5)
    for n in [*range(9, 90), 150, 151, 400, 1000, 1001]:
        for _ in range(4):
            union = rng.choice(1 << 60, n, replace=False).astype(np.uint64)
            most = n // 10
            drop = rng.permutation(n)[:most]
            cut = rng.integers(0, most + 1) if most else 0
            a, b = np.sort(np.delete(union, drop[:cut])), np.sort(np.delete(union, drop[cut:]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 90 * (len(a) + len(b) - both)
            if not np.array_equal(a, b):
                assert np.intersect1d(token_groups.part_keys(a), token_groups.part_keys(b)).size


def test_matrix_links_open_every_group_they_need():
    rng = random.Random(2)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10**6), 60)
        for _ in range(12):
            some = set(base)
            for x in rng.sample(base, rng.randint(0, 4)):
                some.remove(x)
                some |= {rng.randrange(10**6) for _ in range(rng.randint(0, 1))}
            sets.append(some)
    arrays = [np.sort(np.array(list(s), np.uint64)) for s in sets]
    label = list(range(len(sets)))

    def join(p, q):
        nonlocal label
        label = [label[p] if x == label[q] else x for x in label]

    for p, q in token_groups.matrix_links(arrays):
        both = len(sets[p] & sets[q])
        assert 100 * both >= 90 * (len(sets[p]) + len(sets[q]) - both)
        join(p, q)
    got = {frozenset(i for i, x in enumerate(label) if x == k) for k in label}
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert any(i in g and j in g for g in got)


def plain_audit(docs, labels) -> Counter:
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    big = lambda d: (1 << 63) if d is None else d
    least = {}
    for d, text, _ in docs:
        least[text or ""] = min(least.get(text or "", 1 << 64), big(d))
    fails, parts = [], defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails.append("".join(k for k, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), big(d) > least[text],
        )) if x))
        parts[lang or ""].append((d, fails[-1]))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, k in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d, f in rows if k in f and not before & set(f)]
                shapley[part, k] += len(gone)
                out.append((part, order, step, k, sum(not (before | {k}) & set(f) for _, f in rows), len(gone), sum(k in f and bool(before & set(f)) for _, f in rows),
                            sum(f == k for _, f in rows), sum(d in good for d in gone if d is not None), sum(d in toxic for d in gone if d is not None)))
    return Counter((*r, shapley[r[0], r[3]]) for r in out)


def test_filter_audit(spark):
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(400)] + ["É"] * 10
    texts = [None, "", " ", "AB CD", "one # two", "A" + "é" * 30, " ".join(vocab[:210]), " ".join(["same"] * 250)]
    for _ in range(40):
        w = [rng.choice(vocab[: rng.choice([40, 400])]) for _ in range(rng.choice([30, 199, 200, 300]))]
        w[rng.randrange(len(w))] = rng.choice(["x", "%", "ABCDEFG" * rng.randint(1, 9)])
        texts.append(" \t\n\x0b"[rng.randrange(4)].join(w))
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(300)]
    docs += [(None, texts[9], "en"), (None, texts[9], "en"), (4, texts[9], "en"), (4, texts[9], "en"), (4, texts[10], "xx"), (None, None, None), (None, "unseen elsewhere", "en"), (None, "unseen elsewhere", "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    a = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, name string, n int").repartition(5)
    b = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")
    out = filter_audit.filter_audit(a, b)
    columns = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in out.select(columns).collect()) == plain_audit(docs, labels)
    assert filter_audit.filter_audit(a.limit(0), b).isEmpty()
    assert filter_audit.filter_audit(a, b.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first() == (0, 0)
