"""Which fixed-length windows of a corpus occur more than once: the distribution part.

Both exact substring operators ask, for every window of W symbols (words or bytes), whether the
same window starts somewhere else. Sending every window through a shuffle costs many times the
input, so windows travel in runs:

* In each window the gram of smallest hash is its *anchor* (leftmost on a tie). Equal windows have
  equal anchors at equal offsets. Consecutive windows with one anchor form a run, and only
  (anchor hash, run hash, place) is shuffled: about 2 / (W - gram + 2) rows a symbol.
* Anchors that occur once cannot hold a repeat and are dropped by a semi-join on their counts.
* Runs with equal content are counted with map-side combine, so a third of all documents being
  copies of one text costs one row a task for each of its runs.
* Only one representative of each content goes on, with its symbols, to an index over bounded
  shards (`kernel`), all runs of one anchor in one shard.
* An anchor with more than `MOST` different contents is not put into one shard. Its runs are cut
  into shorter ones whose key is the part that all their windows share. That key is longer, so
  what was a common anchor with many contexts falls apart; at run length 1 the key is the whole
  window and counting alone decides. No case is dropped at any level.

`earlier=True` marks windows whose content also starts at a smaller (doc_id, hash of the text, position);
`earlier=False` marks windows that also start anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import text as tx
from recallspark.sources.staging import staged

#: Different contents of one anchor that one index shard takes.
MOST = 128
#: Places of one content from which on they are not gathered by their content.
HOT = 1000
#: Symbols in an index shard, and rows of a task's output batch.
SHARD_SYMBOLS, OUT_ROWS = 1 << 20, 20_000

LOW = np.uint64((1 << 22) - 1)  # a block holds fewer symbols than this


@dataclass(frozen=True)
class Windows:
    """What the windows are: W symbols, anchors of `gram`, run lengths of the finer levels."""

    unit: str  # "word" or "byte"
    width: int
    gram: int
    finer: tuple[int, ...]
    earlier: bool
    kernel: Callable

    @property
    def run(self) -> int:
        return self.width - self.gram + 1


def units(w: Windows, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(symbols, bounds of documents in them, their rows, position of their first symbol).

    Blocks of documents; a document of more than one block comes in parts that overlap by
    width - 1 symbols, so that every window lies in exactly one part.
    """
    for i, j in tx.blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        giant = hi - lo > tx.BLOCK
        at, base = lo, 0
        while True:
            to = hi
            if giant and hi - at > tx.BLOCK:
                to = part_end(data, at, hi, 2 * w.width) if w.unit == "word" else at + tx.BLOCK
            part = data[at:to]
            docs = np.array([0]) if giant else offsets[i:j] - lo
            if w.unit == "byte":
                sym = part.astype(np.uint64) + np.uint64(1)
                bounds, first = np.append(docs, len(part)), None
            else:
                first, last = tx.word_bounds(part, docs)
                sym = tx.word_hashes(part, first, last)
                bounds = np.append(np.searchsorted(first, docs), len(first))
            yield sym, bounds, np.arange(i, j), base
            if to >= hi:
                break
            back = len(sym) - w.width + 1
            if w.unit == "byte":
                at, base = at + back, base + back
            else:
                at, base = at + int(first[back]) if back < len(first) else to, base + back


def part_end(data: np.ndarray, at: int, hi: int, least: int) -> int:
    """End of the part that starts at `at`: after a word, with at least `BLOCK` bytes and `least`
    words in it, or the end `hi` of the document."""
    to, words, before = at, 0, True
    while to < hi and words < least:
        space = tx.SPACE[data[to : min(hi, to + tx.BLOCK)]]
        words += int(np.count_nonzero(~space & np.append(before, space[:-1])))
        to, before = to + len(space), bool(space[-1])
    while to < hi:
        gap = np.flatnonzero(tx.SPACE[data[to : min(hi, to + tx.BLOCK)]])
        if len(gap):
            return to + int(gap[0])
        to = min(hi, to + tx.BLOCK)
    return to


def run_rows(w: Windows, sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor offset, anchor hash, run hash)."""
    none = (np.zeros(0, np.int64),) * 6
    size = np.diff(bounds)
    if len(sym) < w.width:
        return none
    sums, less = tx.prefix_sums(sym, w.unit), tx.prefix_sums(sym, "more")
    n = len(sym) - w.gram + 1
    grams = tx.mixed((sums[w.gram :] - sums[:-w.gram]) * tx.powers(w.unit, n)[1][:n])
    keys = (grams & ~LOW) | np.arange(n, dtype=np.uint64)
    least = (tx.windows_min(keys, w.run) & LOW).astype(np.int64)
    starts = tx.runs(bounds[:-1], np.maximum(size - w.width + 1, 0))
    if not len(starts):
        return none
    anchor = least[starts]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.append(0, cut)
    many = np.diff(np.append(first, len(starts)))
    start, anchor = starts[first], anchor[first]
    content = tx.spans_hash(less, "more", start, start + many - 1 + w.width)
    doc = np.searchsorted(bounds, start, "right") - 1
    return doc, start, many, anchor - start, grams[anchor], content


def place(pos: np.ndarray, many: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First window, number of windows and anchor offset in one long, ordered by the first."""
    return (pos.astype(np.int64) << 32) | (many.astype(np.int64) << 16) | off.astype(np.int64)


def _runs_of(w: Windows):
    names = ["core", "content", "did", "tie", "at"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = tx.ids_of(batch.column(0)), tx.ids_of(batch.column(1))
            data, offsets = tx.text_buffer(batch.column(2))
            for sym, bounds, rows, base in units(w, data, offsets):
                doc, start, many, off, core, content = run_rows(w, sym, bounds)
                if len(doc):
                    cols = [core.view(np.int64), content.view(np.int64), ids[rows[doc]], ties[rows[doc]], place(start - bounds[doc] + base, many, off)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return task


def _segments(w: Windows):
    """Symbols of the wanted runs of each document, from its text."""

    def task(batches):
        for batch in batches:
            out = {k: [] for k in ("core", "did", "tie", "at", "n", "m", "seg")}
            held = 0
            for did, tie, body, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = (body.as_py() or "").encode()
                words = raw.split() if w.unit == "word" else raw
                seen: dict[bytes, int] = {}
                for x in want:
                    pos, many = x["at"] >> 32, (x["at"] >> 16) & 0xFFFF
                    seg = words[pos : pos + many - 1 + w.width]
                    if w.unit == "word":
                        for y in seg:
                            if y not in seen:
                                seen[y] = xxhash.xxh64_intdigest(y)
                        seg = np.array([seen[y] for y in seg], np.uint64).tobytes()
                    for k, v in (("core", x["core"]), ("did", did), ("tie", tie), ("at", x["at"]), ("n", x["n"]), ("m", x["m"]), ("seg", seg)):
                        out[k].append(v)
                    held += len(seg)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            if out["core"]:
                yield _batch(out)

    return task


_KINDS = {"core": pa.int64(), "content": pa.int64(), "did": pa.int64(), "tie": pa.int64(), "at": pa.int64(), "n": pa.int64(), "m": pa.int64(), "seg": pa.binary()}
_SEG = "core long, did long, tie long, at long, n long, m long, seg binary"


def _batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for k, v in out.items()], names=list(out))


def _split(w: Windows, step: int):
    """Cut runs into runs of at most `step` windows, keyed by what all windows of a part share."""
    each = 8 if w.unit == "word" else 1

    def task(batches):
        for batch in batches:
            out = {k: [] for k in ("core", "content", "did", "tie", "at", "n", "seg")}
            for did, tie, at, n, seg in zip(*(batch.column(k).to_pylist() for k in ("did", "tie", "at", "n", "seg"))):
                pos, many, off = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
                for q in range((off - many + 1) // step, off // step + 1):
                    high, low = min(off, (q + 1) * step - 1), max(off - many + 1, q * step)
                    skip, count = off - high, high - low + 1
                    part = seg[skip * each : (skip + count - 1 + w.width) * each]
                    a = off - q * step  # the windows of the whole part share [a, a + width - step + 1)
                    core = xxhash.xxh64_intdigest(seg[a * each : (a + w.width - step + 1) * each], q * 2 + 1)
                    row = (core, xxhash.xxh64_intdigest(part, 2), did, tie, (pos + skip) << 32 | count << 16 | high, n, part)
                    for k, v in zip(out, row):
                        out[k].append(v - (1 << 64) if k in ("core", "content") and v >> 63 else v)
            if out["core"]:
                yield _batch(out)

    return task


def _shards(w: Windows):
    """Runs sorted by anchor: whole anchors together in shards of bounded size, to the kernel."""

    def found(rows):
        rows.sort(key=lambda x: x[1:4])
        spans = w.kernel([x[5] for x in rows], np.array([(x[3] >> 16) & 0xFFFF for x in rows]), w.width)
        for k, a, b in spans:  # windows [a, b) of run k
            if w.earlier or rows[k][4] < 2:
                pos = rows[k][3] >> 32
                yield *rows[k][1:3], pos + a, pos + b - 1 + w.width

    def task(batches):
        rows, held, last, each, ready = [], 0, None, 8 if w.unit == "word" else 1, []
        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in ("core", "did", "tie", "at", "n", "seg"))):
                if x[0] != last and held >= SHARD_SYMBOLS:
                    ready += found(rows)
                    rows, held = [], 0
                    if len(ready) > OUT_ROWS:
                        yield _spans(ready)
                        ready = []
                last = x[0]
                rows.append(x)
                held += len(x[5]) // each + 1
        if rows:
            ready += found(rows)
        if ready:
            yield _spans(ready)

    return task


def _spans(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["did", "tie", "a", "b"])


def _counted(w: Windows, rows: DataFrame, carry: list[str]) -> DataFrame:
    """One row a content: its count, its first place (with `carry`), contents of its anchor."""
    first = F.min(F.struct("did", "tie", "at", *carry)).alias("f")
    groups = rows.groupBy("core", "content").agg(F.sum("n").alias("n"), first)
    return staged(groups.select("core", "content", "n", *(F.col(f"f.{k}").alias(k) for k in ("did", "tie", "at", *carry))), "contents")


def _answers(w: Windows, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Spans that counting alone decides: all windows of a run whose content is held more than once
    (or, if only earlier places count, of all such runs but the first)."""
    rows = rows.select("core", "content", "did", "tie", "at")
    if w.earlier:
        groups = groups.select("core", "content", "n", F.col("did").alias("did1"), F.col("tie").alias("tie1"), (F.col("at") / F.lit(1 << 32)).cast("long").alias("p1"))
        odd = ~((F.col("did") == F.col("did1")) & (F.col("tie") == F.col("tie1")) & (F.shiftright("at", 32) == F.col("p1")))
    else:
        groups = groups.where("n >= 2").select("core", "content", "n")
        odd = F.lit(True)
    pos, many = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF)
    # Contents that many places share are few (places / HOT at most); Spark broadcasts them if their written
    # size allows it, so that their places need not meet in one task.
    hot = staged(groups.where(F.col("n") > HOT).drop("n"), "hot")
    keys = ["core", "content"]
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("n") <= HOT).drop("n"), keys)
    both = cold.unionByName(rows.join(hot, keys))
    return both.where(odd).select("did", "tie", pos.alias("a"), (pos + many - 1 + w.width).alias("b"))


def _mixed_anchors(groups: DataFrame) -> DataFrame:
    """Contents whose anchor has other contents too, with their number m."""
    many = staged(groups.groupBy("core").agg(F.count("*").alias("m")).where("m >= 2"), "mixed")
    return groups.join(many, "core")


def once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents (did, tie, text) without repeated rows, and (did, tie, rows) of those that were repeated, if any:
    however many rows share a doc_id (or have none) and a text, their spans are found and kept once."""
    docs = docs.select("did", "tie", "text").where("text is not null")
    again = staged(docs.groupBy("did", "tie").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    if again.isEmpty():
        return docs, None
    keys = ["did", "tie"]
    return docs.join(again, keys, "left_anti").unionByName(docs.join(again, keys, "left_semi").dropDuplicates(keys)), again


def repeated_spans(docs: DataFrame, w: Windows) -> DataFrame:
    """(did, tie, a, b): spans of symbols covered by repeated windows, for documents (did, tie, text).

    Spans overlap and may be met more than once; their union for a document is exact.
    """
    docs, again = once(docs)
    runs = docs.mapInArrow(_runs_of(w), "core long, content long, did long, tie long, at long")
    # written, so that both sides of the join are plain exchanges and AQE can split a hot anchor
    if again is None:
        often = staged(runs.groupBy("core").agg(F.count("*").alias("c")).where("c >= 2").select("core"), "often")
        kept = runs.join(often, "core", "left_semi").withColumn("n", F.lit(1).cast("long"))
    else:
        runs = runs.join(again, ["did", "tie"], "left").select("core", "content", "did", "tie", "at", F.coalesce("rows", F.lit(1)).cast("long").alias("n"))
        often = staged(runs.groupBy("core").agg(F.sum("n").alias("c")).where("c >= 2").select("core"), "often")
        kept = runs.join(often, "core", "left_semi")
    kept = staged(kept, "runs")
    groups = _counted(w, kept, [])
    spans = [_answers(w, kept, groups)]
    want = _mixed_anchors(groups).groupBy("did", "tie").agg(F.collect_list(F.struct("core", "at", "n", "m")).alias("want"))
    rows = staged(docs.join(want, ["did", "tie"]).mapInArrow(_segments(w), _SEG), "segments")
    for step in (*w.finer, None):
        few = rows.where(F.col("m") <= MOST).repartition(F.col("core")).sortWithinPartitions("core")
        spans.append(few.mapInArrow(_shards(w), "did long, tie long, a long, b long"))
        rows = rows.where(F.col("m") > MOST)
        if step is None or rows.isEmpty():
            break
        parts = staged(rows.mapInArrow(_split(w, step), "core long, content long, did long, tie long, at long, n long, seg binary"), "parts")
        groups = _counted(w, parts, ["seg"])
        spans.append(_answers(w, parts, groups))
        rows = staged(_mixed_anchors(groups).select("core", "did", "tie", "at", "n", "m", "seg"), "segments")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out
