"""Document fingerprints from prefix polynomial hashes.

For each text two modular prefix arrays (base B, primes 2**31 - 1 and 2**31 - 19, over code points)
answer the equality of any two spans in constant time. The fingerprint holds the length, the hash
of the whole text, and for each of `CELLS` cells the least hash of the text's `SPAN`-character spans
that fall in the cell (one-permutation sketch). Likeness is the share of cells, of those that either
text fills, that agree; 1 for equal fingerprints. Common prefixes are located by binary search over
the prefix arrays.

The next document, in descending order of doc_id, is found with one range partitioning: rows are
sorted inside partitions and processed as a stream; only the last row of each partition waits for
the first row of the next one (two rows a partition).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.text import mixed
from recallspark.sources.staging import staged

SPAN, CELLS = 12, 64
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
EMPTY = (1 << 16) - 1

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, modulo the prime."""
    if not _powers or len(_powers[0][0]) <= n:
        size, out = max(1 << 14, 1 << (n + 1).bit_length()), []
        for p, b in zip(PRIMES, BASES):
            pair = []
            for x in (b, pow(b, -1, p)):
                a = np.ones(size, np.uint64)
                have = 1
                while have < size:
                    step = np.uint64(pow(x, have, p))
                    a[have : 2 * have] = a[:have] * step % np.uint64(p)
                    have *= 2
                pair.append(a)
            out.append(tuple(pair))
        _powers[:] = out
    return _powers


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Prefix:
    """Prefix arrays of one text; `extend` shares them with a text that has a common beginning."""

    def __init__(self, code: np.ndarray):
        self.n = len(code)
        self.sums = []
        for p, (up, _) in zip(PRIMES, _power_tables(self.n)):
            a = np.zeros(self.n + 1, np.uint64)
            np.cumsum((code + np.uint64(1)) * up[: self.n] % np.uint64(p), out=a[1:])
            a %= np.uint64(p)
            self.sums.append(a)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans [start, end), independent of where they are."""
        out = np.zeros(len(start), np.uint64)
        for p, (_, down), a in zip(PRIMES, _power_tables(self.n), self.sums):
            q = np.uint64(p)
            out = (out << np.uint64(31)) | (a[end] + q - a[start]) % q * down[start] % q
        return out

    def every(self, width: int) -> np.ndarray:
        n = self.n - width + 1
        out = np.zeros(n, np.uint64)
        for p, (_, down), a in zip(PRIMES, _power_tables(self.n), self.sums):
            q = np.uint64(p)
            out = (out << np.uint64(31)) | (a[width:] + q - a[:n]) % q * down[:n] % q
        return out

    def equal(self, i: int, other: "Prefix", j: int, length: int) -> bool:
        one = np.array([i]), np.array([i + length])
        two = np.array([j]), np.array([j + length])
        return bool(self.spans(*one)[0] == other.spans(*two)[0])

    def common(self, i: int, other: "Prefix", j: int) -> int:
        """Longest common extension of position i here and position j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def sketch(prefix: Prefix) -> np.ndarray:
    """Least span hash of each cell, its upper 16 bits; EMPTY in cells without a span."""
    cells = np.full(CELLS, (1 << 64) - 1, np.uint64)
    if prefix.n:
        h = mixed(prefix.every(min(SPAN, prefix.n)))
        np.minimum.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), mixed(h) >> np.uint64(1))
        # the least value of a full cell is near zero, so it is mixed again before it is cut to 16 bits
        full = cells < np.uint64(1 << 63)
        return np.where(full, mixed(cells) % np.uint64(EMPTY), np.uint64(EMPTY))
    return np.full(CELLS, EMPTY, np.uint64)


def printed(prefix: Prefix, cells: np.ndarray) -> str:
    whole = int(prefix.spans(np.array([0]), np.array([prefix.n]))[0])
    return f"{prefix.n:x}:{whole:016x}:" + cells.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rpartition(":")[2]), ">u2") for s in (a, b))
    filled = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & filled).sum() / filled.sum()) if filled.any() else 0.0


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many first ones of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _row(did, text: str, own: tuple, after: str, after_print: str | None) -> tuple:
    prefix, mark = own
    other = edited(text, after)
    changed = Prefix(points(other))
    changed_mark = printed(changed, sketch(changed))
    if after_print is None:
        after_print = _print(after)[1]
    return (did, prefix.n, hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, after_print), prefix.common(0, changed, 0))


def _print(text: str) -> tuple[Prefix, str]:
    prefix = Prefix(points(text))
    return prefix, printed(prefix, sketch(prefix))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
_ENDS = RESULT + ", part int, first string, last_id long, last string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition; at the end one row with its first text and its last document."""
    part = TaskContext.get().partitionId()
    first = last = None
    for batch in batches:
        rows = []
        for did, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = _print(text)
            if last is None:
                first = text
            else:
                rows.append(_row(*last, text, own[1]))
            last = did, text, own
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)]
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *none], names=[*_NAMES, "part", "first", "last_id", "last"])
    if last is not None:
        ends = [pa.nulls(1, t) for t in _KINDS] + [pa.array([part], pa.int32()), pa.array([first]), pa.array([last[0]], pa.int64()), pa.array([last[1]])]
        yield pa.RecordBatch.from_arrays(ends, names=[*_NAMES, "part", "first", "last_id", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(did, text, _print(text), after, None) for did, text, after in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def document_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    A NULL text is empty; NULL doc_ids come last in the descending order; rows that share a doc_id
    are ordered by the hash of their text; a single document is its own next one; an empty table gives an empty
    result; other columns are ignored.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    # ranges by id and hash: rows without an id, or many of one id, fall into ranges too
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    table = staged(rows.mapInArrow(_stream, _ENDS), "prints")
    ends = table.where("part is not null").select("part", "first", "last_id", "last")
    # as many rows as partitions: the next partition's first text, and for the last the very first
    by_part = Window.orderBy("part")
    top = F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = ends.select("last_id", "last", F.coalesce(F.lead("first").over(by_part), top).alias("after")).mapInArrow(_ends, RESULT)
    return table.where("part is null").select(*_NAMES).unionByName(last)
