"""Array helpers for the text operators: words, hashes and windows of whole Arrow batches.

Everything here works on one bounded block of bytes at a time (`BLOCK`); the distribution of the
work is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task. Some twenty arrays of eight bytes a byte stand beside it, and a worker
#: keeps the powers for the next task.
BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NO_ID = (1 << 63) - 1  # stands for a NULL doc_id: it sorts last

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "more": 0xDA942042E4DD58B5}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base modulo 2**64 and of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        out = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[kind] = tuple(out)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray, kind: str) -> np.ndarray:
    """Prefix array of the polynomial hash modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(kind, len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, kind: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end) from a prefix array."""
    return mixed((sums[end] - sums[start]) * powers(kind, len(sums))[1][start] + (end - start).astype(np.uint64))


def windows_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys."""
    have, span = keys, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, NULL as empty; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def ids_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [i, j) of at most `most` bytes, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of adjacent documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    new = np.zeros(n + 1, bool)
    new[doc_starts[doc_starts < n]] = True
    new[[0, n]] = True
    first = word & new[:-1]
    first[1:] |= word[1:] & ~word[:-1]
    last = word & new[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1), "byte"), "byte", start, end)
