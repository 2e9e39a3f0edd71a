"""Conversation prefix trie by mergeable partial tries.

Conversations are rebuilt (a number of first turns is taken from another one), and every distinct sequence
of first turns is a node:

* *Turns.* A turn travels as 16 bytes of MD5 and its number of words, never as text. Turns are sorted over
  ranges of (conversation, turn), so a conversation that holds a third of all turns is spread over tasks. A
  task numbers its rows and keeps prefix sums of a polynomial hash; what a conversation has in earlier
  ranges (a row a range and conversation that crosses one) is added by arithmetic.
* *Partial tries.* The hash of a rebuilt prefix follows from these sums, in any task and for any turn alone.
  Each task emits locally combined node tables: node, parent, number of members, the smallest one, and
  the list of conversations that end there.
* *Merges.* The tables of a task are merged by node, and so are the tables of all tasks: numbers of members
  add up (a root that all conversations share is one row a table). Lists of ends are merged twice: over ranges
  of (node, conversation), which splits a list of any length, then in order by node, streamed into its digest.
* *Rollup.* Nodes with one member are a chain that ends in one leaf and saves nothing. The others are rolled
  up from the bottom by doubling: after round k a node holds the sums of its descendants within 2**k levels and
  gives them to the ancestor that many levels up, so a depth of 400 takes nine rounds.

Defined results: NULL roles and texts are empty; turns are ordered by number, NULL first, and turns of one number
by the MD5 of role and text; repeated rows are turns each; rows without a conv_id belong to no conversation; an empty
table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import text as tx
from recallspark.sources.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations take up to HEADS - 1 first turns from the one whose conv_id is the multiple of BASE below.
BASE, HEADS = 20, 4
#: Rows of a partial table; ids of a piece of a list.
BLOCK, PIECE = 1 << 18, 1 << 16

_KINDS = ("word", "more")


def _u(column) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    arrays = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in arrays], names=[x.split()[0] for x in schema.split(", ")])


def _power(kind: str, n: np.ndarray) -> np.ndarray:
    return tx.powers(kind, int(n.max(initial=0)))[0][n]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, name, words): the MD5 of role and text, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )


_NUMBERED = "conv_id long, pid int, at long, s1 long, s2 long, t1 long, t2 long, words long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, name, words): place in the conversation and prefix sums, both within this range."""
    pid, last, at0, sums = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * 2
    for batch in batches:
        conv = np.asarray(batch.column(0))
        n = len(conv)
        if not n:
            continue
        data, offsets = tx.text_buffer(batch.column(1))
        name = data[offsets[0] : offsets[-1]].view(np.uint64).reshape(-1, 2)
        start = np.flatnonzero(np.append(conv[0] != last, conv[1:] != conv[:-1]))
        first = np.zeros(n, np.int64)
        first[start] = start
        first = np.maximum.accumulate(first)
        at = np.arange(n) - first + 1
        going = np.arange(n) < (start[0] if len(start) else n)  # rows of the conversation the last batch ended in
        at[going] += at0
        shown = []
        for i, kind in enumerate(_KINDS):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(name[:, i] * _power(kind, at), out=total[1:])
            s = total[1:] - total[first]
            s[going] += sums[i]
            shown.append(s)
        last, at0, sums = conv[-1], int(at[-1]), [s[-1] for s in shown]
        yield _batch(_NUMBERED, conv, np.full(n, pid, np.int32), at, *shown, name[:, 0], name[:, 1], batch.column(2))


_CROSSING = "conv_id long, pid int, n0 long, o1 long, o2 long"


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, pid, at, s1, s2) of the last turns of conversations in their ranges, in order: the number of
    turns in earlier ranges, and their sums."""
    last, n0, o = None, 0, [0, 0]
    for batch in batches:
        out = []
        for conv, pid, at, *s in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != last:
                last, n0, o = conv, 0, [0, 0]
            out.append((conv, pid, n0, *(((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63) for x in o)))
            n = np.array([n0])
            o = [x + y * int(_power(kind, n)[0]) for x, y, kind in zip(o, s, _KINDS)]
            n0 += at
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))], names=["conv_id", "pid", "n0", "o1", "o2"])


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, at, s1, s2, t1, t2, words, n0, o1, o2): turn n0 + at of its conversation; the sums up to it are
    o + s * base ** n0."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(rows, "turns").repartitionByRange(parts, "conv_id", "turn", "name").sortWithinPartitions("conv_id", "turn", "name")
    found = staged(rows.select("conv_id", "name", "words").mapInArrow(_number, _NUMBERED), "numbered")
    # conversations in two ranges or more: at most one a range
    crossing = found.where("at = 1").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    lasts = found.join(crossing, "conv_id", "left_semi").groupBy("conv_id", "pid").agg(F.max(F.struct("at", "s1", "s2")).alias("l"))
    lasts = lasts.select("conv_id", "pid", "l.*").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "pid")
    earlier = staged(lasts.mapInArrow(_earlier, _CROSSING), "earlier")
    out = found.join(F.broadcast(earlier), ["conv_id", "pid"], "left")  # two rows a range at most
    return out.select("conv_id", "at", "s1", "s2", "t1", "t2", "words", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "o1", "o2")))


_FLAT = [f"{x}_{x2}{i}" for x in ("own", "head") for i in range(HEADS - 1) for x2 in ("t1", "t2", "words")]
_REBUILT = "conv_id long, n long, taken long, have long, c1 long, c2 long, " + ", ".join(f"{x} long" for x in _FLAT if x.startswith("head"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation with its own first turns and those of its base. The sum of a rebuilt prefix that ends in
    an own turn is c + own sum / base ** (taken - have)."""
    for batch in batches:
        conv, n, taken, have = (np.asarray(batch.column(i)) for i in range(4))
        flat = {x: _u(batch.column(4 + i)) for i, x in enumerate(_FLAT)}
        skip = np.minimum(taken, n)
        c = []
        for k, kind in enumerate(_KINDS):
            power, back = tx.powers(kind, HEADS)
            head, own = np.zeros(len(conv), np.uint64), np.zeros(len(conv), np.uint64)
            for i in range(HEADS - 1):
                head += np.where(have > i, flat[f"head_t{k + 1}{i}"], 0).astype(np.uint64) * power[i + 1]
                own += np.where(skip > i, flat[f"own_t{k + 1}{i}"], 0).astype(np.uint64) * power[i + 1]
            c.append(head - own * back[taken - have])
        yield _batch(_REBUILT, conv, n, taken, have, *c, *(v for x, v in flat.items() if x.startswith("head")))


def rebuilt(rows: DataFrame) -> DataFrame:
    """A row a conversation: turns, turns taken from (and found in) its base, and what their hashes add."""
    place = F.col("n0") + F.col("at")
    early = F.when(place < HEADS, F.struct(place.alias("place"), "t1", "t2", "words"))
    each = rows.groupBy("conv_id").agg(F.max(place).alias("n"), F.sort_array(F.collect_list(early)).alias("first"))
    base = each.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    both = each.withColumn("taken", taken).join(base, F.col("base") == F.col("conv_id") - F.col("conv_id") % BASE, "left")
    flat = [F.get(f, F.lit(i))[x].alias(f"{name}_{x}{i}") for name, f in (("own", "first"), ("head", "head")) for i in range(HEADS - 1) for x in ("t1", "t2", "words")]
    have = F.least("taken", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    return both.select("conv_id", "n", "taken", F.greatest(have, F.lit(0)).alias("have"), *flat).mapInArrow(_rebuild, _REBUILT)


_PARTIAL = "k1 long, k2 long, p1 long, p2 long, depth long, words long, members long, least long, ends binary"


def node_keys(sums: list[np.ndarray], depth: np.ndarray) -> list[np.ndarray]:
    """128 bits of the hash sums of a prefix and its length."""
    return [tx.mixed(s + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sums]


class Partial:
    """Rows of a task, combined into node tables of at most `BLOCK` rows before."""

    def __init__(self):
        self.rows, self.n = [], 0

    def add(self, sums, terms, depth, words, conv, ends) -> Iterator[pa.RecordBatch]:
        """Prefixes by their sums; `terms` is what the last turn adds to them; `ends`: it is the whole conversation."""
        key, parent = node_keys(sums, depth), node_keys([s - t for s, t in zip(sums, terms)], depth - 1)
        self.rows.append((*key, *parent, depth.astype(np.int64), words.astype(np.int64), conv.astype(np.int64), ends))
        self.n += len(conv)
        if self.n >= BLOCK:
            yield from self.emit()

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        k1, k2, p1, p2, depth, words, conv, ends = (np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.n = [], 0
        order = np.lexsort((conv, k2, k1))
        k1, k2, conv, ends = k1[order], k2[order], conv[order], ends[order]
        at = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        first = order[at]
        count = np.diff(np.append(at, len(k1)))
        many = np.add.reduceat(ends.astype(np.int64), at)
        where = np.append(0, np.cumsum(many) * 8).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(conv[ends]))])
        yield _batch(_PARTIAL, k1[at], k2[at], p1[first], p2[first], depth[first], words[first], count, conv[at], lists)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `rebuilt`: the root, and the nodes of turns from the base."""
    table = Partial()
    for batch in batches:
        conv, n, taken, have = (np.asarray(batch.column(i)) for i in range(4))
        flat = [_u(c) for c in batch.columns[6:]]  # t1, t2, words of each place
        sums = [np.zeros(len(conv), np.uint64) for _ in _KINDS]
        over = n <= taken  # nothing of its own is left
        yield from table.add(sums, [np.uint64(0)] * 2, np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64), conv, over & (have == 0))
        for i in range(HEADS - 1):
            t = [flat[3 * i + k] * tx.powers(kind, HEADS)[0][i + 1] for k, kind in enumerate(_KINDS)]
            sums = [s + x for s, x in zip(sums, t)]
            on = have > i
            yield from table.add([s[on] for s in sums], [x[on] for x in t], np.full(int(on.sum()), i + 1), flat[3 * i + 2][on], conv[on], (over & (have == i + 1))[on])
    yield from table.emit()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns with what `rebuilt` says of their conversation: their nodes."""
    table = Partial()
    for batch in batches:
        conv, at, n0, n, taken, have = (np.asarray(batch.column(i)) for i in range(6))
        s, o, c, t = ([_u(batch.column(i)), _u(batch.column(i + 1))] for i in (6, 8, 10, 12))
        depth = n0 + at - taken + have
        sums, terms = [], []
        for k, kind in enumerate(_KINDS):
            back = tx.powers(kind, HEADS)[1][taken - have]
            sums.append(c[k] + (o[k] + s[k] * _power(kind, n0)) * back)
            terms.append(t[k] * _power(kind, depth))
        yield from table.add(sums, terms, depth, np.asarray(batch.column(14)), conv, n0 + at == n)
    yield from table.emit()


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (k1, k2, ends) as rows."""
    for batch in batches:
        data, offsets = tx.text_buffer(batch.column(2))
        many = np.diff(offsets) // 8
        conv = data[offsets[0] : offsets[-1]].view(np.int64)
        yield _batch("k1, k2, conv", np.repeat(np.asarray(batch.column(0)), many), np.repeat(np.asarray(batch.column(1)), many), conv)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, conv) in order: lists of at most `PIECE` ids."""
    for batch in batches:
        k1, k2, conv = (np.asarray(c) for c in batch.columns)
        if not len(conv):
            continue
        at = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        at = np.unique(np.concatenate([at, np.arange(0, len(conv), PIECE)]))
        where = (np.append(at, len(conv)) * 8).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(conv))])
        yield _batch("k1, k2, low, ends", k1[at], k2[at], conv[at], lists)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (k1, k2, ends) in order: the SHA-256 of each node's ids, fed piece by piece."""
    last, digest = None, None
    for batch in batches:
        out = []
        for *key, ends in zip(*(c.to_pylist() for c in batch.columns)):
            text = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
            if key == last:
                digest.update(b"," + text)
                continue
            if last is not None:
                out.append((*last, digest.hexdigest()))
            last, digest = key, hashlib.sha256(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "digest"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, digest.hexdigest())], names=["k1", "k2", "digest"])


def end_digests(partial: DataFrame) -> DataFrame:
    """(k1, k2, digest) of the nodes at which conversations end."""
    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = partial.where(F.length("ends") > 0).select("k1", "k2", "ends").mapInArrow(_ids, "k1 long, k2 long, conv long")
    ids = ids.repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    pieces = staged(ids.mapInArrow(_pieces, "k1 long, k2 long, low long, ends binary"), "ends")
    ordered = pieces.repartition(F.col("k1"), F.col("k2")).sortWithinPartitions("k1", "k2", "low").select("k1", "k2", "ends")
    return ordered.mapInArrow(_digests, "k1 long, k2 long, digest string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """(k1, k2, leaves, saved) summed over subtrees, of (k1, k2, a1, a2 (the parent), depth, leaves, saved)."""
    now = staged(shared, "shared")
    deepest, far = now.agg(F.max("depth")).first()[0] or 0, 1
    while far <= deepest:
        given = now.where(F.col("depth") >= far).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = now.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        moved = now.where(F.col("depth") >= 2 * far).join(up, ["a1", "a2"]).select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), "depth", "leaves", "saved")
        rest = now.where(F.col("depth") < 2 * far).select("k1", "k2", F.lit(0).cast("long").alias("a1"), F.lit(0).cast("long").alias("a2"), "depth", "leaves", "saved")
        summed = moved.unionByName(rest).join(given, ["k1", "k2"], "left")
        now = staged(summed.select(
            "k1", "k2", "a1", "a2", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ), "rollup")
        far *= 2
    return now.select("k1", "k2", "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the name of the node (node_id, parent_id: 32 hex digits)."""
    rows = numbered(turns(conversations))
    each = staged(rebuilt(rows), "rebuilt")
    own = rows.join(each.select("conv_id", "n", "taken", "have", "c1", "c2"), "conv_id").where(F.col("n0") + F.col("at") > F.col("taken"))
    own = own.select("conv_id", "at", "n0", "n", "taken", "have", "s1", "s2", "o1", "o2", "c1", "c2", "t1", "t2", "words")
    partial = staged(each.mapInArrow(_heads, _PARTIAL).unionByName(own.mapInArrow(_own, _PARTIAL)), "partial")
    nodes = staged(partial.groupBy("k1", "k2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("members").alias("members"), F.min("least").alias("least"),
    ), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("members") == 1).alias("lone"))
    nodes = staged(nodes.join(below, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    shared = nodes.where("members > 1").select(
        "k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), "depth",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("lone")).cast("long").alias("leaves"), ((F.col("members") - 1) * F.col("words")).alias("saved"),
    )
    above = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    child = nodes.where("depth > 0").join(above, ["p1", "p2"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = child.join(rolled_up(shared), ["k1", "k2"], "left").join(end_digests(partial), ["k1", "k2"], "left")
    name = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        name("k1", "k2").alias("node_id"), F.when(F.col("depth") > 0, name("p1", "p2")).alias("parent_id"),
    )
