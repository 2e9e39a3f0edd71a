"""Near duplicates by the similarity of their shingles: Golay-code fuzzy hashing, then exact Jaccard.

Texts are sets of 5-word shingles (lower-cased words of `simhash`); two are near duplicates if the
Jaccard similarity of the sets is at least 0.8, and near duplicates of near duplicates are one group.
Such pairs differ in about 19 of 128 SimHash bits, too many for the three segments of `simhash`:

* *Fingerprint.* The bitwise majority of 128 hash bits over the set. Texts with one set are one node
  from here on (map-side combine), so copies, however many, are never expanded.
* *Fuzzy keys.* Six segments of 23 or 18 bits, each decoded with its neighbours to 1 or 6 Golay codeword
  indices; words within 2 bits share one. By pigeonhole a pair within 17 bits shares a segment's index
  for sure, and farther pairs (up to `BITS`) share one of the six with high probability. An index has
  only 12 bits, so a key joins it with one of `ANCHORS` shingles of the set that are least under
  as many hashes; of those, alike sets share each with the probability of their similarity.
* *Join.* Equal keys meet in a sorted partition; fingerprints within `BITS` are linked. Links are
  reduced to a star a component and task, keys with more than `BUCKET` fingerprints are compared in blocks.
  Components of the links are loose classes: a superset of the groups.
* *Verify.* The sets of one loose class, once each, meet in a task, which links pairs of exact
  similarity at least 0.8; pairs that other links have joined already are left out. A large class is
  first compared with one of its members, and only what that leaves meets the whole class in blocks.

The recall of the keys is measured in tests/llm against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import text as tx
from recallspark.llm.simhash import BUCKET, Forest, codeword_indices, shingle_hashes
from recallspark.llm.tables import row_keyed, text_key
from recallspark.operators.graph import connected_components
from recallspark.sources.staging import staged

SHINGLE, SIMILARITY, BITS, ANCHORS = 5, 0.8, 34, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18), (64, 23), (87, 23), (110, 18))
#: Sets of one class (and shingles in them) that a task compares in one go.
CLASS, CLASS_SHINGLES = 1024, 1 << 22

_ODD = np.random.default_rng(7).integers(1, 1 << 63, ANCHORS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    every = np.zeros(0, np.uint64)
    for h in shingle_hashes(text, shingle):
        every = np.union1d(every, h)
    return every


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set, as two numbers."""
    if not len(shingles):
        return np.zeros(2, np.uint64)
    votes = np.zeros(128, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        both = np.stack([part, tx.mixed(part ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        votes += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(shingles), bitorder="little").view(np.uint64)


def anchors(shingles: np.ndarray) -> list[int]:
    """Least hash of the set under each of `ANCHORS` hashes."""
    return [int(tx.mixed(shingles * a).min().view(np.int64)) for a in _ODD] if len(shingles) else []


_PRINTS = "did long, tie long, fp binary, name binary, size long, anchors array<long>"


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(did, tie, fp, name, size, anchors) of every document; `name` tells shingle sets apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(2)]
            fp = [wide_print(s).tobytes() for s in sets]
            name = [f + xxhash.xxh64_digest(s.tobytes(), 3) for f, s in zip(fp, sets)]
            cols = [pa.array(fp, pa.binary()), pa.array(name, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([anchors(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["did", "tie", "fp", "name", "size", "anchors"])

    return row_keyed(docs).mapInArrow(task, _PRINTS)


def _codes(column: pa.Array) -> np.ndarray:
    """16-byte fingerprints as rows of two numbers."""
    data, offsets = tx.text_buffer(column)
    return data[offsets[0] : offsets[-1]].view(np.uint64).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def _bits(code: np.ndarray, at: int, n: int) -> np.ndarray:
    return ((code[:, at // 64] >> np.uint64(at % 64)) & np.uint64((1 << n) - 1)).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = _codes(batch.column(0))
        anchor = np.array(batch.column(1).to_pylist(), np.int64).reshape(len(code), ANCHORS).view(np.uint64)
        for at in range(0, len(code), 1024):
            some, own = code[at : at + 1024], anchor[at : at + 1024]
            for tag, (a, n) in enumerate(SEGMENTS):
                near = codeword_indices(_bits(some, a, n))
                row, k = np.nonzero(near >= 0)
                index = (near[row, k] << 3 | tag).astype(np.uint64)
                for j in range(ANCHORS):
                    key = tx.mixed(own[row, j] + index * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), _binary(some[row])], names=["key", "fp"])


def _binary(code: np.ndarray) -> pa.Array:
    where = np.arange(len(code) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(code))])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def near_rows(key: np.ndarray, code: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of fingerprints within `bits` under equal keys (rows sorted by key). Of a group
    of many rows, pairs that are joined already are left out."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    few = np.repeat(size < 48, size)
    at, gap = np.flatnonzero(few), 1
    while len(at):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        near = at[_apart(code[at], code[at + gap]) <= bits]
        if len(near):
            yield near, near + gap
        gap += 1
    for a, n in zip(start[size >= 48].tolist(), size[size >= 48].tolist()):
        part, label = code[a : a + n], np.arange(n)
        for p in range(n):
            other = np.flatnonzero(label != label[p])
            if not len(other):
                break
            hit = other[_apart(part[other], part[p]) <= bits]
            if len(hit):
                yield np.full(len(hit), a + p), a + hit
                label[np.isin(label, label[hit])] = label[p]


_WIDE = "a binary, b binary, wide long"


def _loose(bits: int, most: int):
    """Rows (key, fp) sorted by key: at the end of a task each fingerprint is linked to the smallest one that
    it reaches there, so that tasks which meet one group agree in most of their links; a key of more than
    `most` rows comes back as `wide` instead."""
    kinds = (pa.binary(), pa.binary(), pa.int64())

    def join(forest, key, code):
        for i, j in near_rows(key, code, bits):
            for a, b in zip(code[i], code[j]):
                forest.join(a.tobytes(), b.tobytes())

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["a", "b", "wide"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, wide = Forest(), None
        key, code = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
        for one in batches:
            more = np.asarray(one.column(0))
            skip = int(np.searchsorted(more, wide, "right")) if wide is not None else 0
            key, code = np.concatenate([key, more[skip:]]), np.concatenate([code, _codes(one.column(1))[skip:]])
            if not len(key):
                continue
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            big = key[start[np.diff(np.append(start, len(key))) > most]]
            if len(big):
                wide = int(big[-1])
                keep = ~np.isin(key, big)
                key, code = key[keep], code[keep]
                yield batch([(None, None, x) for x in big.tolist()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            join(forest, key[:whole], code[:whole])
            key, code = key[whole:], code[whole:]
        join(forest, key, code)
        found = [(x, forest.root(x), None) for x in list(forest.up)]
        for at in range(0, len(found), 10_000):
            yield batch(found[at : at + 10_000])

    return task


def _met(keys: DataFrame, bits: int, most: int) -> DataFrame:
    return keys.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_loose(bits, most), _WIDE)


def loose_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between fingerprints of nodes (fp, anchors), a star a component and task."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.where(F.size("anchors") > 0).select("fp", "anchors").repartition(parts, "fp").mapInArrow(_keys, "key long, fp binary")
    found = staged(_met(keys, bits, BUCKET), "links")
    out, wide = found.where("wide is null"), found.where("wide is not null").select(F.col("wide").alias("key")).distinct()
    if not wide.isEmpty():
        wide = staged(keys.join(wide, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / (BUCKET // 4)).cast("int").alias("parts")), "wide")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        each = keys.join(wide, "key").select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "fp")
        cells = each.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        out = out.unionByName(staged(_met(cells, bits, 1 << 40), "links"))
    return out.select("a", "b")


def alike(sets: list[np.ndarray], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Pairs of sets of Jaccard similarity `least` or more that join two groups, each set taken as a
    pivot against those that are not in its group yet."""
    n, size = len(sets), np.array([len(s) for s in sets])
    label = np.arange(n)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    edge = np.cumsum(size) - size
    mark = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    for p in range(n):
        other = label != label[p]
        if not other.any():
            return
        own = ids[edge[p] : edge[p] + size[p]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], edge)
        mark[own] = 0
        hit = np.flatnonzero(other & (both >= least * (size + size[p] - both)))
        for q in hit.tolist():
            if label[q] != label[p]:
                yield p, q
                label[label == label[q]] = label[p]


_LINKS = "a binary, b binary"


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])


def _verify(least: float):
    """Rows (class, name, set) sorted by class and name: exact links of each class."""

    def links(names, sets):
        return [(names[p], names[q]) for p, q in alike(sets, least)] if len(names) > 1 else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets, ready = None, [], [], []
        for batch in batches:
            for k, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if k != last:
                    ready += links(names, sets)
                    last, names, sets = k, [], []
                if not names or names[-1] != name:  # a repeated row has the same name
                    names.append(name)
                    sets.append(np.frombuffer(raw, np.uint64))
            if len(ready) > 1024:
                yield _pairs(ready)
                ready = []
        ready += links(names, sets)
        if ready:
            yield _pairs(ready)

    return task


def _to_leader(least: float):
    """Rows (name, set, leader, lead): links to the leader of the class."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, raw, leader, lead in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(raw, np.uint64), np.frombuffer(lead, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if name != leader and both >= least * (len(a) + len(b) - both):
                    found.append((name, leader))
            if found:
                yield _pairs(found)

    return task


def _sets(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["class", "name", "parts", "set"])

    return task


def exact_links(docs: DataFrame, members: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) of names in members (class, name, size, did, tie), verified on the texts."""
    size = members.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / CLASS), F.ceil(F.col("m") / CLASS_SHINGLES)).cast("int")
    wanted = members.join(size.select("class", parts.alias("parts")), "class")
    rows = row_keyed(docs).join(wanted, ["did", "tie"]).select("class", "name", "parts", "text")
    rows = staged(rows.mapInArrow(_sets(shingle), "class binary, name binary, parts int, set binary"), "sets")

    def verified(cells):
        return cells.repartition(F.col("class")).sortWithinPartitions("class", "name").mapInArrow(_verify(least), _LINKS)

    out = staged(verified(rows.where("parts = 1").select("class", "name", "set")), "alike")
    large = rows.where("parts > 1")
    if not large.isEmpty():
        lead = staged(large.groupBy("class").agg(F.min(F.struct("name", "set")).alias("l")).select("class", F.col("l.name").alias("leader"), F.col("l.set").alias("lead")), "leaders")
        near = staged(large.join(lead, "class").select("name", "set", "leader", "lead").mapInArrow(_to_leader(least), _LINKS), "alike")
        done = near.select(F.col("a").alias("name")).unionByName(lead.select(F.col("leader").alias("name"))).distinct()
        rest = staged(large.join(done, "name", "left_anti").select("class", "name").distinct(), "rest")
        blocks = rest.groupBy("class").agg(F.ceil(F.count("*") / CLASS).cast("int").alias("rows"))
        # what the leader left meets the whole class: (block of the rest, block of the class) is a cell
        mark = rest.withColumn("own", F.pmod(F.xxhash64("name"), F.lit(1 << 20)))
        each = large.join(mark, ["class", "name"], "left").join(blocks, "class")
        column = F.pmod(F.xxhash64("name", F.lit(1)), F.col("parts")).cast("int")
        as_rest = each.where("own is not null").select("class", "name", "set", F.pmod("own", "rows").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c"))
        as_all = each.select("class", "name", "set", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), column.alias("c"))
        cells = as_rest.unionByName(as_all).select(F.concat("class", F.encode(F.concat_ws(",", "r", "c"), "utf-8")).alias("class"), "name", "set")
        out = out.unionByName(near).unionByName(staged(verified(cells), "alike"))
    return out


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """(did, tie, component, first): the group of each document, named by its smallest (did, tie)."""
    every = staged(prints(docs, shingle), "prints")
    nodes = staged(every.groupBy("name").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("anchors").alias("anchors"), F.min(F.struct("did", "tie")).alias("least")), "nodes")
    loose = connected_components(loose_links(nodes, bits)).select(F.col("node").alias("fp"), "root")
    members = staged(nodes.join(loose, "fp", "left").select(F.coalesce("root", "fp").alias("class"), "name", "size", "least.did", "least.tie"), "members")
    found = connected_components(exact_links(docs, members, shingle, similarity)).select(F.col("node").alias("name"), "root")
    nodes = staged(nodes.join(found, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root")), "roots")
    least = nodes.groupBy("root").agg(F.min("least").alias("f")).select("root", F.col("f.did").alias("component"), F.col("f.tie").alias("first"))
    return every.select("did", "tie", "name").join(nodes.join(least, "root").select("name", "component", "first"), "name").select("did", "tie", "component", "first")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """The documents that are the smallest doc_id of their group (the smallest hash of the text where
    several share it or have none); repeated rows of it stay once.

    Texts without words (NULL, empty) are one group; texts of fewer words than a shingle are one
    shingle; a NULL doc_id sorts last; different texts under one doc_id are documents of their own; an
    empty table gives an empty result; all columns are kept, whatever their names.
    """
    keep = groups(docs, shingle, similarity, bits).where("did = component and tie = first").select("did", "tie").distinct()
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(tx.NO_ID)).alias("did")
    kept = docs.select(did, text_key(), *columns).join(keep, ["did", "tie"], "left_semi").dropDuplicates(["did", "tie"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
