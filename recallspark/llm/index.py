"""Suffix order, Burrows-Wheeler transform and a bit-packed wavelet matrix over one shard."""

from __future__ import annotations

import numpy as np

from recallspark.llm.text import runs


def suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in the order of their first `depth` symbols at least (prefix doubling), and the
    ranks of the prefixes met on the way as (length, rank of each position)."""
    n = len(sym)
    ids = np.unique(sym, return_inverse=True)[1].astype(np.int64).reshape(-1)
    length, kept = 1, [(1, ids)]
    bits = (int(ids.max()) + 1).bit_length() if n else 1
    pack = min(62 // bits, depth // 2)
    if pack > 1:  # several symbols in one key at first
        key = np.zeros(n, np.int64)
        for k in range(pack):
            key <<= bits
            key[: n - k] += ids[k:] + 1
        ids, length = _dense(key), pack
        kept.append((length, ids))
    while length < depth:
        key = ids * (n + 1)
        key[: n - length] += ids[length:] + 1
        ids, length = _dense(key), length * 2
        kept.append((length, ids))
    return np.argsort(ids, kind="stable"), kept


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    have = key[order]
    step = np.empty(len(key), np.int64)
    step[:1] = 0
    np.cumsum(have[1:] != have[:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank


def prefix_groups(order: np.ndarray, kept: list, length: int) -> np.ndarray:
    """For each place of the suffix order, where its group of equal `length`-symbol prefixes starts
    (positions too close to the end count as different)."""
    have, rank = max((x for x in kept if x[0] <= length), key=lambda x: x[0])
    n = len(order)
    a = rank[order]
    later = order + (length - have)
    b = np.where(later < n, rank[np.minimum(later, n - 1)], -1 - order)
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    return start[np.cumsum(new) - 1]


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, 64 bits to a word with counts."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.levels, self.zeros = len(seq), [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for k in range(self.depth - 1, -1, -1):
            bit = ((seq >> k) & 1).astype(bool)
            padded = np.zeros((len(seq) // 64 + 1) * 64, bool)
            padded[: len(seq)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=counts[1:])
            self.levels.append((words, counts))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, counts = self.levels[level]
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & mask)

    def range_of(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) mapped to the places of `sym` at the lowest level."""
        for level in range(self.depth):
            one = ((sym >> (self.depth - 1 - level)) & 1).astype(bool)
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo = np.where(one, a + self.zeros[level], lo - a)
            hi = np.where(one, b + self.zeros[level], hi - b)
        return lo, hi

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, lo, hi) at the lowest level of every symbol in each of the ranges [lo, hi)."""
        sym = np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            a, b = self.ones(level, lo), self.ones(level, hi)
            zero, one = (hi - b) > (lo - a), b > a
            z = self.zeros[level]
            lo, hi = np.concatenate([(lo - a)[zero], (a + z)[one]]), np.concatenate([(hi - b)[zero], (b + z)[one]])
            sym = np.concatenate([sym[zero] << 1, (sym[one] << 1) | 1])
        return sym, lo, hi


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a shard.

    Of the transform only the wavelet matrix stays: levels of packed bits with a count a word. The lowest
    level lists the places of each symbol together; `base[c]` is where symbol c starts there, `head[c]`
    the first suffix that starts with c.
    """

    def __init__(self, sym: np.ndarray, bwt: np.ndarray):
        self.n, self.sigma = len(sym), int(sym.max()) + 1
        self.wavelet = WaveletMatrix(bwt, self.sigma)
        count = np.bincount(sym, minlength=self.sigma)
        self.head = np.cumsum(count) - count
        every = np.arange(self.sigma, dtype=np.int64)
        self.base = self.wavelet.range_of(every, np.zeros(self.sigma, np.int64), np.zeros(self.sigma, np.int64))[0]

    def step(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + P from the intervals of P."""
        a, b = self.wavelet.range_of(sym, lo, hi)
        move = self.head[sym] - self.base[sym]
        return a + move, b + move

    def steps(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + P for every symbol c before P."""
        sym, a, b = self.wavelet.children(lo, hi)
        move = self.head[sym] - self.base[sym]
        return a + move, b + move


def spans_of(marked: list[tuple[np.ndarray, np.ndarray]]):
    """(run, first, end) of the stretches of marked windows, from (run, window) pairs."""
    if not marked:
        return
    run, win = (np.concatenate(x) for x in zip(*marked))
    if not len(run):
        return
    order = np.lexsort((win, run))
    run, win = run[order], win[order]
    new = np.append(True, (run[1:] != run[:-1]) | (win[1:] != win[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(run)) - 1
    yield from zip(run[first].tolist(), win[first].tolist(), (win[last] + 1).tolist())


def earlier_windows(segs: list[bytes], many: np.ndarray, width: int):
    """Windows of word runs that also start earlier in the shard, in reading order.

    The runs are streamed against the FM-index of the shard from their ends backwards, all at once:
    each step extends the match to the left. A match of `width` words is above the threshold, and where
    its interval starts names the window: the first run and place that ask for it are its first. The
    match is then cut to its first width - 1 words before the next step: the interval widens to the
    edges of the suffixes that share so many words, which are kept as bits. The suffix order and its ranks
    are dropped once the transform and the edges are made.
    """
    words = [np.frombuffer(x, np.uint64) for x in segs]
    size = np.array([len(x) for x in words])
    ids = np.unique(np.concatenate(words), return_inverse=True)[1].reshape(-1) + 1
    begin = np.cumsum(size + 1) - size - 1
    sym = np.zeros(int((size + 1).sum()), np.int64)
    sym[runs(begin, size)] = ids
    order, kept = suffix_order(sym, width)
    index = FMIndex(sym, sym[order - 1])
    group = prefix_groups(order, kept, width - 1)
    edges = Edges(np.append(True, group[1:] != group[:-1]))
    del order, kept, group
    lane = np.arange(len(segs))
    lo, hi = np.zeros(len(segs), np.int64), np.full(len(segs), index.n)
    match = np.zeros(len(segs), np.int64)
    found = []
    for t in range(int(size.max())):
        on = lane[size > t]
        at = size[on] - 1 - t
        full = on[match[on] == width]
        lo[full], hi[full] = edges.around(lo[full])
        match[full] = width - 1
        lo[on], hi[on] = index.step(sym[begin[on] + at], lo[on], hi[on])
        match[on] += 1  # the runs are part of the shard, so every match goes on
        hit = on[match[on] == width]
        found.append((lo[hit].copy(), hit, size[hit] - 1 - t))
    if not found:
        return
    window, run, at = (np.concatenate(x) for x in zip(*found))
    first = np.full(index.n, np.iinfo(np.int64).max)
    np.minimum.at(first, window, begin[run] + at)
    early = first[window] < begin[run] + at
    yield from spans_of([(run[early], at[early])])


class Edges:
    """A bit a place of the suffix order where a group starts, with counts and the sampled places of ones."""

    def __init__(self, new: np.ndarray):
        padded = np.zeros((len(new) // 64 + 1) * 64, bool)
        padded[: len(new)] = new
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])
        self.starts = np.append(np.flatnonzero(new), len(new)).astype(np.int32)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the group of each place starts and ends."""
        word = at >> 6
        upto = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        k = self.counts[word] + np.bitwise_count(upto) - 1
        return self.starts[k].astype(np.int64), self.starts[k + 1].astype(np.int64)


def repeated_windows(segs: list[bytes], many: np.ndarray, width: int):
    """Windows of byte runs that start anywhere else in the shard too.

    Breadth-first backward extension: the intervals of all prefixes of length l give, by one
    extension to the left, those of length l + 1; an interval whose right edge has no common-prefix
    value yet sets it to l and is extended further. Values come in increasing order, and the search
    stops at `width`: edges without a value then separate suffixes that share `width` bytes.
    """
    size = np.array([len(x) for x in segs])
    begin = np.cumsum(size + 1) - size - 1
    sym = np.zeros(int((size + 1).sum()), np.int64)
    raw = np.frombuffer(b"".join(segs), np.uint8)
    used = np.unique(raw)
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    sym[runs(begin, size)] = code[raw]
    order = suffix_order(sym, width)[0]
    bwt = sym[order - 1]
    index, n = FMIndex(sym, bwt), len(sym)
    seen = np.zeros(n + 1, bool)
    seen[[0, n]] = True
    back = _one_step(bwt)
    del bwt
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(width):
        one = hi - lo == 1
        a, b = index.steps(lo[~one], hi[~one])
        single = back[lo[one]]
        lo, hi = np.concatenate([a, single]), np.concatenate([b, single + 1])
        fresh = ~seen[hi]
        lo, hi = lo[fresh], hi[fresh]
        seen[hi] = True
        if not len(lo):
            break
    shared = np.zeros(n, bool)  # places of the suffix order that share `width` bytes with a neighbour
    inner = ~seen[1:n]
    shared[1:] |= inner
    shared[:-1] |= inner
    at = np.sort(order[shared])
    run = np.searchsorted(begin, at, "right") - 1
    win = at - begin[run]
    fits = win < many[run]
    yield from spans_of([(run[fits], win[fits])])


def _one_step(bwt: np.ndarray) -> np.ndarray:
    """Place of the suffix one symbol longer, for every place."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(len(bwt))
    return out
