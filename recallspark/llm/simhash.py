"""SimHash near-dedup by fuzzy hashing with the binary Golay code.

The fingerprint of a text is the bitwise majority of XXH64 over its 4-word shingles. Documents
whose fingerprints differ in at most 4 of 64 bits are linked, and linked documents form classes.

* Documents are grouped by fingerprint first (map-side combine): copies, however many, are one row
  from here on and are never expanded into pairs.
* A fingerprint is cut into three segments of 22, 21 and 21 bits. Each segment, read as a 23-bit
  word, is decoded to the nearest codeword of the perfect (23, 12, 7) code, and so are its 23
  neighbours at one bit: 1 or 6 codeword indices. Two words within 2 bits have a word between them
  at one bit from both, so they share an index.
* Pigeonhole of 4 differing bits over three segments: either every segment differs, then none in
  more than 2 bits, and all three share an index (key: three indices); or a segment is equal, and of
  the others one differs in at most 2 bits (key: the equal segment and an index of the other).
* Keys of 34 and 36 bits seldom meet by chance, so candidates grow with the links and not with the
  square of the corpus. Equal keys meet in a sorted partition; candidates are verified on 64 bits.
* Verified links are reduced to a spanning forest inside each key and task before they leave it.
  A key with more than `BUCKET` fingerprints is compared in blocks (i, j) of that size spread over
  tasks; none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import text as tx
from recallspark.llm.tables import row_keyed, text_key
from recallspark.operators.graph import connected_components
from recallspark.sources.staging import staged

SHINGLE, BITS = 4, 4
#: Fingerprints of one key compared in one go.
BUCKET = 1024

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, in bounded parts."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    xx = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    for i in range(0, n, 1 << 16):
        a, b = starts[i : min(n, i + (1 << 16))].tolist(), ends[i + k - 1 : min(n, i + (1 << 16)) + k - 1].tolist()
        yield np.array([xx(joined[p:q], 42) for p, q in zip(a, b)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 if it has no word."""
    votes, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        n += len(h)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(did, tie, fp) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["did", "tie", "fp"])

    return row_keyed(docs).mapInArrow(task, "did long, tie long, fp long")


_golay: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error pattern of a syndrome."""
    if not _golay:
        low = np.zeros(1 << 12, np.int64)
        high = np.zeros(1 << 11, np.int64)
        one = []
        for bit in range(23):
            x = 1 << bit
            for k in range(bit, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            one.append(x)
        for bit in range(12):
            low ^= np.where(np.arange(1 << 12) >> bit & 1, one[bit], 0)
        for bit in range(11):
            high ^= np.where(np.arange(1 << 11) >> bit & 1, one[bit + 12], 0)
        error = np.zeros(1 << 11, np.int64)
        flips = [(1 << i, one[i]) for i in range(23)]
        for i, (a, s) in enumerate(flips):
            error[s] = a
            for j, (b, t) in enumerate(flips[:i]):
                error[s ^ t] = a | b
                for c, u in flips[:j]:
                    error[s ^ t ^ u] = a | b | c
        _golay.extend([low, high, error])
    return _golay


def codeword_index(word: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (word ^ error[low[word & 0xFFF] ^ high[word >> 12]]) >> 11


def codeword_indices(word: np.ndarray) -> np.ndarray:
    """The indices reached from each word and its neighbours, in order, -1 in unused places."""
    near = np.stack([codeword_index(word), *(codeword_index(word ^ (1 << b)) for b in range(23))])
    near.sort(axis=0)
    near[1:][near[1:] == near[:-1]] = -1
    near = -np.sort(-near, axis=0)
    return near[:6].T


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = np.asarray(batch.column(0)).view(np.uint64)
        for at in range(0, len(every), 1024):
            fp = every[at : at + 1024]
            same = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            near = [codeword_indices(x) for x in same]
            three = (near[0][:, :, None, None] << 24) | (near[1][:, None, :, None] << 12) | near[2][:, None, None, :]
            row, *at3 = np.nonzero((near[0] >= 0)[:, :, None, None] & (near[1] >= 0)[:, None, :, None] & (near[2] >= 0)[:, None, None, :])
            yield _keyed(three[row, *at3], fp[row])
            for tag, (i, j) in enumerate(permutations(range(3), 2), 1):
                row, k = np.nonzero(near[j] >= 0)
                yield _keyed((tag << 40) | (same[i][row] << 12) | near[j][row, k], fp[row])


def _keyed(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp.view(np.int64))], names=["key", "fp"])


class Forest:
    """Union-find over the nodes a task has met; says whether a link joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs among rows sorted by key: rows at each distance, as long as keys agree."""
    at, gap, code = np.arange(len(key)), 1, fp.view(np.uint64)
    while len(at):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        near = at[np.bitwise_count(code[at] ^ code[at + gap]) <= bits]
        if len(near):
            yield fp[near], fp[near + gap]
        gap += 1


def _verify(bits: int, most: int):
    """Rows (key, fp) sorted by key: links within each key that join two trees of the task's forest;
    a key of more than `most` rows comes back as `wide` instead."""

    names = ["a", "b", "wide"]

    def rows(forest, key, fp):
        for a, b in _links(key, fp, bits):
            new = [x for x in zip(a.tolist(), b.tolist()) if x[0] != x[1] and forest.join(*x)]
            if new:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*new)), pa.nulls(len(new), pa.int64())], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, wide = Forest(), None
        key = fp = np.zeros(0, np.int64)
        for batch in batches:
            more, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            skip = int(np.searchsorted(more, wide, "right")) if wide is not None else 0
            key, fp = np.concatenate([key, more[skip:]]), np.concatenate([fp, prints[skip:]])
            if not len(key):
                continue
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            big = np.diff(np.append(start, len(key))) > most
            for x in key[start[big]].tolist():
                wide = x
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([x], pa.int64())], names=names)
            if big.any():
                keep = ~np.isin(key, key[start[big]])
                key, fp = key[keep], fp[keep]
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from rows(forest, key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
        yield from rows(forest, key, fp)

    return task


def _met(keys: DataFrame, bits: int, most: int) -> DataFrame:
    return keys.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_verify(bits, most), "a long, b long, wide long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), a spanning forest a task."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = prints.select("fp").repartition(parts, "fp").mapInArrow(_keys, "key long, fp long")
    found = staged(_met(keys, bits, BUCKET), "links")
    out, wide = found.where("wide is null"), found.where("wide is not null").select(F.col("wide").alias("key")).distinct()
    if not wide.isEmpty():
        # blocks by a hash of the fingerprint, and a cell for each two blocks
        wide = staged(keys.join(wide, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / (BUCKET // 4)).cast("int").alias("parts")), "wide")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        each = keys.join(wide, "key").select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "fp")
        cells = each.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        out = out.unionByName(staged(_met(cells, bits, 1 << 40), "links"))
    return out.select("a", "b")


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(did, tie, fp, component, first): the class of each document is the smallest did it reaches;
    first is that document's tie."""
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min(F.struct("did", "tie")).alias("least")), "nodes")
    found = connected_components(links(nodes, bits)).select(F.col("node").alias("fp"), "root")
    nodes = staged(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = nodes.groupBy("root").agg(F.min("least").alias("f")).select("root", F.col("f.did").alias("component"), F.col("f.tie").alias("first"))
    return prints.join(nodes.join(least, "root").select("fp", "component", "first"), "fp").select("did", "tie", "fp", "component", "first")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    A NULL text has no word (fingerprint zero, linked like any other); a NULL doc_id sorts last and
    shows as NULL, also as a component's id if nothing else is in it; rows that share a doc_id keep
    their own fingerprints; an empty table gives an empty result; other columns are ignored.
    """
    out = classes(docs, bits)
    shown = lambda c: F.when(F.col(c) != F.lit(tx.NO_ID), F.col(c))
    return out.select(shown("did").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown("component").alias("component_id"))


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents that are the smallest doc_id of their class (the smallest hash of the text where
    several share it or have none); repeated rows of it stay once."""
    keep = classes(docs, bits).where("did = component and tie = first").select("did", "tie").distinct()
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(tx.NO_ID)).alias("did")
    kept = docs.select(did, text_key(), *columns).join(keep, ["did", "tie"], "left_semi").dropDuplicates(["did", "tie"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
