"""Exact Jaccard join of shingle sets with a token-group matrix.

A document is the set of its distinct 3-word shingles; two documents link if the similarity of their
sets is at least `PER_CENT` / 100. All links count, none is estimated:

* *Sets.* Documents with one set are one node (map-side combine), so copies are never expanded.
* *Classes.* Linked sets of n and m shingles differ in at most (n + m) / 19 of them. The tokens of a set
  are dealt by a hash into one part more than the sets of its size class may differ in, so two linked sets
  agree in a whole part for certain. Equal parts (of several tokens each, hence selective: one frequent
  passage makes no two parts equal) meet in a sorted partition and are linked to its first row, a star
  a component and task. Components of these links are classes: no link crosses two of them.
* *Token-group matrix.* In a class, similar sets (one least token) are one group, of which the matrix
  holds the union of tokens. A set asks the matrix for its overlap with every union at once; a group whose
  overlap is below what a link needs holds no partner and stays closed. Members of the others are opened,
  those of the asking set's own component left out, and compared exactly.
* *Large classes.* A class of more than `CLASS_TOKENS` tokens is first compared with the set most
  documents hold; what is not linked with it asks the whole class, cut into blocks of rows of the matrix.
  Only that rest times the blocks travels.

A part that is empty says nothing; a set with such a part adds its parts under the next hash, as its partner
does (their parts agree, so both are empty), and at the last hash empty parts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import text as tx
from recallspark.llm.simhash import Forest
from recallspark.llm.tables import row_keyed
from recallspark.operators.graph import connected_components
from recallspark.sources.staging import staged

SHINGLE, PER_CENT = 3, 90
#: Tokens, and sets, of a class (or of a cell of a large one) that a task compares in one go.
CLASS_TOKENS, CLASS_SETS = 1 << 22, 1 << 15
#: Sets of a group, hashes tried for parts, names a task remembers.
GROUP, HASHES, SEEN = 64, 8, 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    data, offsets = tx.text_buffer(texts)
    for i, j in tx.blocks(offsets):
        part = _LOWER[data[offsets[i] : offsets[j]]]
        first = offsets[i : j + 1] - offsets[i]
        start, end = tx.word_bounds(part, first[:-1])
        word = tx.word_hashes(part, start, end)
        edge = np.searchsorted(start, first)
        n = max(0, len(word) - shingle + 1)
        every = np.zeros(n, np.uint64)
        for k in range(shingle):
            every += word[k : k + n] * _PLACES[k]
        every = tx.mixed(every)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= shingle:
                yield np.unique(every[a : b - shingle + 1])
            elif b > a:
                yield tx.mixed((word[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def size_classes(most: int, per_cent: int = PER_CENT) -> list[int]:
    """Bounds of size classes: each a third wider than the last, so that the larger set of a link is in the
    class of the smaller one or in the next. Smaller sets than the first bound link with equal ones only."""
    bounds = [max(1, -(-per_cent // (100 - per_cent)))]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 100 // per_cent + 1 + bounds[-1] // 4)
    return bounds


def parts_of(low: int, high: int, per_cent: int = PER_CENT) -> int:
    """One more than two linked sets can differ in, if the smaller has [low, high) tokens: of a union u,
    (100 - per_cent) u / 100 at most, and the sizes add up to 2 u less that."""
    n = high - 1
    both = n + n * 100 // per_cent
    return both * (100 - per_cent) // (100 + per_cent) + 1


def part_keys(tokens: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Hashes of the parts of a set, for its own size class and, if it may be the larger set of a link
    with it, for the one below."""
    n = len(tokens)
    bounds = size_classes(n, per_cent)
    out = []
    for c in range(max(0, len(bounds) - 3), len(bounds) - 1):
        low, high = bounds[c], bounds[c + 1]
        if n < low or n > (high - 1) * 100 // per_cent:
            continue
        parts = parts_of(low, high, per_cent)
        for h in range(HASHES):
            spread = tx.mixed(tokens * _PLACES[h])
            part = (spread % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            have, at = np.unique(part[order], return_index=True)
            key = np.zeros(parts, np.uint64)
            key[have] = np.add.reduceat(tx.mixed(spread ^ _PLACES[8 + h])[order], at)
            full = len(have) == parts
            shown = np.arange(parts) if h == HASHES - 1 else have
            where = (shown + (h << 24) + (c << 32)).astype(np.uint64)  # part, hash and class
            out.append(tx.mixed(key[shown] + where * _PLACES[0]))
            if full:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SETS = "did long, tie long, name binary, short long, size long, keys array<long>"


def set_prints(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """(did, tie, name, short, size, keys) of every document: the name of its set (NULL: empty), 64 bits of it,
    and the keys of its parts, once a task for sets that many documents hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            name, size, keys = [], [], []
            for s in shingle_sets(batch.column(2), shingle):
                name.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                size.append(len(s))
                new = len(s) and name[-1] not in seen
                keys.append(part_keys(s, per_cent).view(np.int64) if new else None)
                if new:
                    seen = set() if len(seen) == SEEN else seen
                    seen.add(name[-1])
            short = pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in name], pa.int64())
            cols = [batch.column(0), batch.column(1), pa.array(name, pa.binary()), short, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["did", "tie", "name", "short", "size", "keys"])

    return row_keyed(docs).mapInArrow(task, _SETS)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, short) sorted by key: rows of one key are linked to its first; at the end of a task each is
    linked to the smallest it reaches there, so that tasks which meet one class agree in most links."""
    forest, key, lead = Forest(), None, None
    for batch in batches:
        k, s = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(k):
            continue
        new = np.append(k[0] != key, k[1:] != k[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, s[at], lead if lead is not None else 0)
        key, lead = k[-1], first[-1]
        other = np.flatnonzero(first != s)
        for a, b in np.unique(np.stack([first[other], s[other]], axis=1), axis=0).tolist():
            forest.join(a, b)
    found = list(forest.up)
    for i in range(0, len(found), 10_000):
        some = found[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([forest.root(x) for x in some], pa.int64())], names=["a", "b"])


def class_links(prints: DataFrame) -> DataFrame:
    """(a, b): short names of sets that agree in a part, a star a component and task."""
    keys = prints.where("keys is not null").select("short", F.explode("keys").alias("key"))
    return staged(keys.select("key", "short").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_stars, "a long, b long"), "links")


def matrix_links(sets: list[np.ndarray], asking: np.ndarray | None = None, per_cent: int = PER_CENT) -> Iterator[tuple[int, int]]:
    """Links (p, q) that join two components: every linked pair with an asking set is in one component of them."""
    n, size = len(sets), np.array([len(s) for s in sets])
    token, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.reshape(-1)
    edge = np.cumsum(size) - size
    # groups: sets of one least token, in pieces
    least = np.minimum.reduceat(tx.mixed(token * _PLACES[15])[ids], edge)
    order = np.argsort(least, kind="stable")
    new = np.append(True, least[order][1:] != least[order][:-1])
    start = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    new |= place % GROUP == 0
    member_at = np.append(np.flatnonzero(new), n)  # members of group g: order[member_at[g]:member_at[g + 1]]
    groups = len(member_at) - 1
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    # the matrix: of each token, the groups whose union holds it
    cells = np.unique(ids * groups + np.repeat(group, size))
    held = np.bincount(cells // groups, minlength=len(token))
    held_at, cells = np.cumsum(held) - held, cells % groups
    # sets of frequent tokens ask first: they have most partners
    often = np.add.reduceat(np.bincount(ids)[ids], edge) / size
    label, mark = np.arange(n), np.zeros(len(token), np.int64)
    for p in np.argsort(-often, kind="stable").tolist():
        if asking is not None and not asking[p]:
            continue
        own = ids[edge[p] : edge[p] + size[p]]
        overlap = np.bincount(cells[tx.runs(held_at[own], held[own])], minlength=groups)
        opened = np.flatnonzero(100 * overlap >= per_cent * size[p])
        some = order[tx.runs(member_at[opened], member_at[opened + 1] - member_at[opened])]
        some = some[(label[some] != label[p]) & (100 * size[some] >= per_cent * size[p]) & (100 * size[p] >= per_cent * size[some])]
        if not len(some):
            continue
        mark[own] = 1
        both = np.add.reduceat(mark[ids[tx.runs(edge[some], size[some])]], np.cumsum(size[some]) - size[some])
        mark[own] = 0
        hit = some[100 * both >= per_cent * (size[some] + size[p] - both)]
        if len(hit):
            joined, first = np.unique(label[hit], return_index=True)
            for q in hit[first].tolist():
                yield p, q
            label[np.isin(label, joined)] = label[p]


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])


def _ask(per_cent: int):
    """Rows (class, ask, name, set) sorted by class and name: the links of each class."""

    def links(names, sets, ask):
        return [(names[p], names[q]) for p, q in matrix_links(sets, np.array(ask), per_cent)] if len(names) > 1 else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets, asks, ready = None, [], [], [], []
        for batch in batches:
            for k, ask, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if k != last:
                    ready += links(names, sets, asks)
                    last, names, sets, asks = k, [], [], []
                if names and names[-1] == name:  # a set that comes twice asks if one of the two does
                    asks[-1] |= ask
                    continue
                names.append(name)
                sets.append(np.frombuffer(raw, np.uint64))
                asks.append(ask)
            if len(ready) > 4096:
                yield _pairs(ready)
                ready = []
        ready += links(names, sets, asks)
        if ready:
            yield _pairs(ready)

    return task


def _to_lead(per_cent: int):
    """Rows (name, set, leader, lead): links with the leader of the class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, raw, leader, lead in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(raw, np.uint64), np.frombuffer(lead, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if name != leader and 100 * both >= per_cent * (len(a) + len(b) - both):
                    found.append((name, leader))
            if found:
                yield _pairs(found)

    return task


def _sets(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([s.tobytes() for s in shingle_sets(batch.column(4), shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], raw], names=["class", "name", "copies", "parts", "set"])

    return task


def exact_links(docs: DataFrame, members: DataFrame, shingle: int, per_cent: int, most_tokens: int, most_sets: int) -> DataFrame:
    """(a, b): names of linked sets among members (class, name, size, copies, did, tie), a forest a class."""
    size = members.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / most_sets), F.ceil(F.col("m") / most_tokens)).cast("int")
    # one plan at every size: members grow with the documents, so they are never sent whole to the texts
    wanted = members.join(size.select("class", parts.alias("parts")), "class").hint("merge")
    rows = row_keyed(docs).join(wanted, ["did", "tie"]).select("class", "name", "copies", "parts", "text")
    rows = staged(rows.mapInArrow(_sets(shingle), "class long, name binary, copies long, parts int, set binary"), "sets")

    def asked(cells: DataFrame) -> DataFrame:
        return cells.repartition(F.col("class")).sortWithinPartitions("class", "name").mapInArrow(_ask(per_cent), "a binary, b binary")

    out = staged(asked(rows.where("parts = 1").select("class", F.lit(True).alias("ask"), "name", "set")), "alike")
    large = rows.where("parts > 1")
    if large.isEmpty():
        return out
    lead = large.groupBy("class").agg(F.max(F.struct("copies", "name", "set")).alias("l")).select("class", F.col("l.name").alias("leader"), F.col("l.set").alias("lead"))
    near = staged(large.join(staged(lead, "leaders"), "class").select("name", "set", "leader", "lead").mapInArrow(_to_lead(per_cent), "a binary, b binary"), "alike")
    done = near.select(F.col("a").alias("name")).unionByName(near.select(F.col("b").alias("name"))).distinct()
    rest = staged(large.select("class", "name", "parts").distinct().join(done, "name", "left_anti"), "rest")
    blocks = rest.groupBy("class").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.lit(most_sets // 4))).cast("int").alias("rows"))
    each = large.join(rest.select("class", "name", F.lit(True).alias("ask")), ["class", "name"], "left").join(blocks, "class")
    own, column = F.pmod(F.xxhash64("name"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("name", F.lit(1)), F.col("parts")).cast("int")
    asking = each.where("ask").select("class", "ask", "name", "set", own.alias("r"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c"))
    asked_of = each.select("class", F.lit(False).alias("ask"), "name", "set", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), column.alias("c"))
    cells = asking.unionByName(asked_of).select(F.xxhash64("class", "r", "c").alias("class"), "ask", "name", "set")
    return out.unionByName(near).unionByName(staged(asked(cells), "alike"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT, most_tokens: int = CLASS_TOKENS, most_sets: int = CLASS_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each document.

    Fewer words than a shingle are one shingle; a NULL text and one without words are empty sets, which
    nothing links with. A NULL doc_id sorts last and shows as NULL, also as a component's id if nothing else
    is in it; texts that share a doc_id, or have none, are documents of their own; repeated rows come
    each; an empty table gives an empty result; other columns are ignored.
    """
    prints = staged(set_prints(docs, shingle, per_cent), "prints")
    nodes = prints.where("name is not null").groupBy("name").agg(F.max("short").alias("short"), F.max("size").alias("size"), F.count("*").alias("copies"), F.min(F.struct("did", "tie")).alias("least"))
    nodes = staged(nodes, "nodes")
    classes = connected_components(class_links(prints)).select(F.col("node").alias("short"), F.col("root").alias("class"))
    members = staged(nodes.join(classes, "short").select("class", "name", "size", "copies", "least.did", "least.tie"), "members")
    found = connected_components(exact_links(docs, members, shingle, per_cent, most_tokens, most_sets)).select(F.col("node").alias("name"), "root")
    nodes = staged(nodes.join(found, "name", "left").select("name", F.col("least.did").alias("did"), F.coalesce("root", "name").alias("root")), "roots")
    least = nodes.groupBy("root").agg(F.min("did").alias("component"))
    named = nodes.join(least, "root").select("name", "component")
    shown = lambda c: F.when(c != F.lit(tx.NO_ID), c)
    out = prints.select("did", "name", "size").join(named, "name", "left")
    return out.select(shown(F.col("did")).alias("doc_id"), F.col("size").alias("n_shingles"), shown(F.coalesce("component", "did")).alias("component_id"))
