"""Quality rules with an isolation forest over rule statistics.

Base rules fail a document outright. The rest are judged by an isolation forest: trees split random
statistics at random values, and documents that few splits isolate are anomalous. The forest is grown
on every document that passes the base rules, and its threshold is calibrated on all labelled rows: the
lowest score at which no more than `FALSE_SHARE` of the good ones are rejected.

Every document is dealt to a tree by a hash, in small tables to several, so that a tree has `EACH`. Trees
grow together, a level a pass over the statistics; what comes to the driver are the extents of open nodes
(at most `TREES` * 2 ** `DEPTH`), whatever the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.sources.staging import staged

TREES, EACH, DEPTH = 128, 128, 9
FALSE_SHARE = 0.002
#: Scores and mean word lengths are ranked as whole numbers; buckets of a pass of the ranking.
GRID, MICRO, BUCKETS = 1 << 40, 1_000_000, 4096
MIN_WORDS, REPEAT_SHARE, WINDOW = 50, 50, 3
#: What is usual: distance of the mean word length from the median, share of repeated lines
#: among words, share of repeated words. Only what goes beyond counts as odd.
USUAL_LENGTH, USUAL_LINES, USUAL_REPEAT = 1.5, 0.02, 0.25
SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = 4


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeat = 0
    if n >= WINDOW:
        ids: dict[bytes, int] = {}
        code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        low = len(ids)
        pair = np.unique(code[:-1] * low + code[1:], return_inverse=True)[1].reshape(-1)
        key = np.unique(pair[:-1] * low + code[2:], return_inverse=True, return_counts=True)
        start = np.flatnonzero(key[2][key[1].reshape(-1)] >= 2)
        mark = np.zeros(n, bool)
        for k in range(WINDOW):
            mark[start + k] = True
        repeat = int(mark.sum())
    return n, len(text) - spaces, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > REPEAT_SHARE * stats[:, 0])


def features(stats: np.ndarray, center: float) -> np.ndarray:
    """What the random splits see: share of symbols, and how far word length, repeated lines and
    repeated words go beyond the usual, so that neither length nor small oddities isolate a document."""
    n, chars, symbols, lines, repeat = np.maximum(stats, 0).astype(float).T
    some = np.maximum(n, 1)
    beyond = np.abs(chars / some - center) - USUAL_LENGTH, lines / some - USUAL_LINES, repeat / some - USUAL_REPEAT
    return np.stack([symbols / np.maximum(chars, 1), *(np.maximum(0, x) for x in beyond)], axis=1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split value, left child, and path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    each: int
    center: float = 5.0  # usual word length
    threshold: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: isolated by fewer splits."""
        total = np.zeros(len(x))
        for feature, value, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                on = np.flatnonzero(f >= 0)
                if not len(on):
                    break
                node[on] = child[node[on]] + (x[on, f[on]] >= value[node[on]])
            total += path[node]
        return 2.0 ** (-(total / max(1, len(self.trees))) / max(_average(self.each), 1e-9))


def _average(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


#: Open nodes of all trees: number of the node in the joined trees, rows, least and most of every feature.
Extents = list[tuple[int, int, np.ndarray, np.ndarray]]


def spread_of(n: int) -> int:
    """Trees that take each of n rows."""
    return max(1, min(TREES, -(-TREES * EACH // max(n, 1))))


def joined(trees: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, value and left child of the nodes of all trees in one row of arrays, and where each tree begins."""
    start = np.cumsum([0, *(len(t[0]) for t in trees)])[:-1]
    feature, value = (np.concatenate([np.asarray(t[k], float) for t in trees]) for k in (0, 1))
    child = np.concatenate([np.asarray(t[2], np.int64) + at for t, at in zip(trees, start)])
    return feature.astype(np.int64), value, child, start


def extents(flat: tuple, least: np.ndarray, x: np.ndarray, keys: np.ndarray, each: int) -> Extents:
    """Rows and extents of the open nodes (of each tree, those from `least` on) among rows x with hashes `keys`."""
    feature, value, child, start = flat
    keys = np.asarray(keys, np.int64)
    to = (keys % TREES)[:, None] + np.arange(each)[None, :] * (2 * (keys // TREES % TREES) + 1)[:, None]
    tree, row = (to % TREES).reshape(-1), np.repeat(np.arange(len(x)), each)
    node = start[tree]
    on = np.arange(len(node))
    while len(on):
        on = on[feature[node[on]] >= 0]
        f = feature[node[on]]
        node[on] = child[node[on]] + (x[row[on], f] >= value[node[on]])
    open_ = node >= start[tree] + least[tree]
    node, row = node[open_], row[open_]
    order = np.argsort(node, kind="stable")
    node, seen = node[order], x[row[order]]
    edge = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    if not len(edge):
        return []
    n = np.diff(np.append(edge, len(node)))
    return list(zip(node[edge].tolist(), n.tolist(), np.minimum.reduceat(seen, edge), np.maximum.reduceat(seen, edge)))


def grow(n: int, found: Callable[[tuple, np.ndarray, int], Extents], seed: int = 7) -> Forest:
    """Trees over n rows, a level at a time; `found` gives the extents of the open nodes over all rows."""
    rng, each = np.random.default_rng(seed), spread_of(n)
    trees: list = [([-1], [0.0], [0], [0.0]) for _ in range(TREES if n > 1 else 0)]
    least = np.zeros(len(trees), np.int64)
    for depth in range(DEPTH + 1 if trees else 0):
        flat, size = joined(trees), np.array([len(t[0]) for t in trees])
        for at, rows, low, high in sorted(found(flat, least, each), key=lambda e: e[0]):
            tree = int(np.searchsorted(flat[3], at, side="right")) - 1
            feature, value, child, path = trees[tree]
            at -= int(flat[3][tree])
            if rows <= 1 or depth == DEPTH or not (high > low).any():
                path[at] = depth + _average(rows)
                continue
            f = int(rng.choice(np.flatnonzero(high > low)))
            feature[at], value[at], child[at] = f, low[f] + (high[f] - low[f]) * (1 - rng.random()), len(feature)
            for side in (feature, value, child, path):
                side.extend([-1 if side is feature else depth + 1.0 if side is path else 0] * 2)
        least = size
        if all(len(t[0]) == k for t, k in zip(trees, size)):
            break
    return Forest([tuple(np.array(c) for c in t) for t in trees], max(1, n * each // TREES))


def fit(x: np.ndarray, seed: int = 7) -> Forest:
    """The forest of rows in memory."""
    keys = np.random.default_rng(seed).integers(0, TREES * TREES, len(x))
    return grow(len(x), lambda flat, least, each: extents(flat, least, x, keys, each), seed)


def ranked(rows: DataFrame, column: str, at: int) -> int:
    """The whole number with `at` smaller or earlier ones in a column, found by counts in ever narrower buckets."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) // BUCKETS + 1
        inside = rows.where(F.col(column).between(low, high))
        for bucket, n in sorted(map(tuple, inside.groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("bucket")).count().collect())):
            if at < n:
                break
            at -= n
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
    return low


def calibrate(forest: Forest, scores: DataFrame) -> Forest:
    """Threshold on labelled rows (good, score in steps of 1 / GRID): at most FALSE_SHARE of the good ones above it; midway
    to the median of the bad scores beyond, if there are any."""
    good, bad = scores.where("good"), scores.where("not good")
    n = good.count()
    if n:
        least = ranked(good, "score", min(n - 1, int(np.ceil(n * (1 - FALSE_SHARE))) - 1))
        above = bad.where(F.col("score") > least)
        m = above.count()
        forest.threshold = (least + ranked(above, "score", (m - 1) // 2)) / 2 / GRID if m else least / GRID + 0.02
    return forest


def rule_statistics(docs: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *STATS])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(task, "doc_id long, " + ", ".join(f"{x} long" for x in STATS))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """Forest of all documents, calibrated on all labelled ones (quality 1: good, 0: bad)."""
    return train_on(rule_statistics(docs), labels)


def train_on(stats: DataFrame, labels: DataFrame) -> Forest:
    """The same of the documents' statistics. Equal rows of one doc_id count once."""
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_SHARE} * n_words"
    passed = staged(stats.distinct().where(f"not ({failed})"), "passed")
    n = passed.count()
    lengths = passed.where("n_words > 0").selectExpr(f"word_chars * {MICRO}L div n_words as length")
    center = ranked(lengths, "length", (n - 1) // 2) / MICRO if n else 5.0
    keyed = passed.select(F.pmod(F.xxhash64("doc_id", *STATS), F.lit(TREES * TREES)).alias("key"), *STATS)

    def found(flat: tuple, least: np.ndarray, each: int) -> Extents:
        share = keyed.sparkSession.sparkContext.broadcast((flat, least))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = np.array([c.to_numpy() for c in batch.columns])
                step = max(1, (1 << 20) // each)
                for at in range(0, batch.num_rows, step):
                    keys, rows = cols[0, at : at + step], features(cols[1:, at : at + step].T, center)
                    parts = extents(*share.value, rows, keys, each)
                    ends = [np.array([e[k] for e in parts], float).reshape(len(parts), FEATURES) for k in (2, 3)]
                    columns = [pa.array([e[k] for e in parts], pa.int64()) for k in (0, 1)] + [pa.array(e[:, f], pa.float64()) for e in ends for f in range(rows.shape[1])]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n", *sides])

        sides = [f"{side}{f}" for side in ("low", "high") for f in range(FEATURES)]
        out = keyed.mapInArrow(task, "node long, n long, " + ", ".join(f"{c} double" for c in sides))
        every = out.groupBy("node").agg(F.sum("n"), *((F.min if c.startswith("low") else F.max)(c) for c in sides)).collect()
        share.unpersist()
        return [(r[0], r[1], np.array(r[2 : 2 + FEATURES]), np.array(r[2 + FEATURES :])) for r in every]

    forest = grow(n, found)
    forest.center = center
    marks = labels.where("quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    known = passed.join(marks, "doc_id").select("good", *STATS)
    share = stats.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([c.to_numpy() for c in batch.columns[1:]]).T
            score = np.ceil(share.value.score(features(rows, center)) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["good", "score"])

    return calibrate(forest, staged(known.mapInArrow(scored, "good boolean, score long"), "scored"))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly (score of the forest) and kept.

    A NULL text has no word and fails the base rules; NULL doc_ids and repeated rows are judged like
    any other; an empty table gives an empty result; other columns are ignored. Without labelled
    rows no document is anomalous.
    """
    return judge_on(rule_statistics(docs), forest)


def judge_on(stats: DataFrame, forest: Forest) -> DataFrame:
    """The same of the documents' statistics."""
    share = stats.sparkSession.sparkContext.broadcast(forest)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([c.to_numpy() for c in batch.columns[1:]], np.int64).T.reshape(-1, len(STATS))
            failed, score = base_failed(rows), share.value.score(features(rows, share.value.center))
            kept = ~failed & (score <= share.value.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *STATS, "base_failed", "kept", "anomaly"])

    kinds = "doc_id long, " + ", ".join(f"{x} long" for x in STATS) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(task, kinds)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`judge` by the forest that `train` grows on the same documents; their texts are read once."""
    stats = staged(rule_statistics(docs), "statistics")
    return judge_on(stats, train_on(stats, labels))
