"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The encoding of a text is the sequence of vocabulary pieces with the largest total score (a Viterbi
path); characters without a piece are encoded as their UTF-8 bytes. Spaces become U+2581 and one is
put in front, as the model's normaliser does; decoding undoes both. A merge model's vocabulary has ranks
and no probabilities; the score of the piece at rank r is the logarithm of 1 / (r + OFFSET), the usual law
of frequencies by rank (nothing is trained). The library merges pairs instead, so its ids may differ.

No piece has U+2581 behind another character, so a text falls into units (a space and what follows
it) whose best paths are independent; a bounded cache keeps those of common units.

A document of more than `CHUNK` characters is cut into chunks anywhere. The state at a cut is how many
characters of the next chunk belong to the piece across it (0 to 15). Each chunk yields a transfer
matrix in the max-plus semiring: the best score from every state at its left cut to every state at
its right cut. Matrices combine associatively: products of `BLOCK` neighbouring chunks first, then
over the blocks of a document (a Spark string holds less than 2 GB, so there are at most 2,048), which
fixes the states at all cuts. Each chunk is then backtraced by itself. Scores are integers, so the
order of combination does not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.text import NO_ID
from recallspark.sources.staging import staged

SPACE = "\u2581"
OWN_SPACE = " "  # stands for a U+2581 of the text itself, which is encoded as bytes: no space is left to mean one
CHUNK, BLOCK, STATES = 32_768, 64, 16
#: Score of one bit, offset of the ranks, score of a character without a piece in bits.
UNIT, OFFSET, UNKNOWN, NEVER = 1 << 16, 301, 64, -(1 << 61)
CACHE, CACHED_CHARS = 300_000, 48
#: A space after something else: no piece goes across its left side.
EDGE = re.compile(f"(?<!{SPACE}){SPACE}")


class Pieces:
    """Vocabulary of a SentencePiece model: values of pieces, and best paths."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.ids: dict[str, int] = {}
        self.value: dict[str, int] = {}
        self.bytes = {}
        for i, piece in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                # a little for the piece itself, so that equal totals are rare
                self.value[piece] = i % 61 - int(log2(max(0.0, -sp.get_score(i)) + OFFSET) * UNIT)
        # how a piece looks in a text, for decoding
        self.raw = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]
        self.unknown = -UNKNOWN * UNIT
        self.longest = min(STATES, max(map(len, self.ids)))
        # the vocabulary as a tree of characters: (value or None, next characters)
        leaf: dict = {}
        self.tree: dict[str, tuple] = {}
        for piece, value in self.value.items():
            if len(piece) <= self.longest:
                kids = self.tree
                for c in piece[:-1]:
                    have = kids.get(c, (None, leaf))
                    if have[1] is leaf:
                        have = kids[c] = have[0], {}
                    kids = have[1]
                kids[piece[-1]] = value, kids.get(piece[-1], (None, leaf))[1]
        self.tree = {c: (self.unknown if x is None else x, kids) for c, (x, kids) in self.tree.items()}
        self.other = self.unknown, leaf
        self.pairs = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        self.cache: dict[str, tuple[int, bytes]] = {}

    def paths(self, text: str, start: int, stop: int) -> tuple[list[int], list[int]]:
        """Best value of reaching each position from `start`, pieces starting before `stop`, and the
        length of the last piece (the longest of equal ones)."""
        n, tree, other = len(text), self.tree, self.other
        best, back = [NEVER] * (n + 1), [0] * (n + 1)
        best[start] = 0
        for p in range(start, stop):
            have = best[p]
            if have == NEVER:
                continue
            x, kids = tree.get(text[p], other)
            if have + x > best[p + 1]:
                best[p + 1], back[p + 1] = have + x, 1
            q = p + 1
            while kids and q < n:
                node = kids.get(text[q])
                if node is None:
                    break
                x, kids = node
                q += 1
                if x is not None and have + x > best[q]:
                    best[q], back[q] = have + x, q - p
        return best, back

    def best_path(self, text: str) -> tuple[int, bytes]:
        """Value and ids of a unit."""
        best, back = self.paths(text, 0, len(text))
        ids = self.ids_of(text, 0, len(text), back)
        return best[-1], struct.pack(f"<{len(ids)}I", *ids)

    def back_to_front(self, text: str, stop: int) -> list[int]:
        """Best value from each position to `stop`."""
        best = [NEVER] * (stop + 1)
        best[stop] = 0
        for p in range(stop - 1, -1, -1):
            best[p] = best[p + 1] + self.value.get(text[p], self.unknown)
            for q in range(p + 2, min(stop, p + self.longest) + 1):
                x = self.value.get(text[p:q])
                if x is not None and best[q] + x > best[p]:
                    best[p] = best[q] + x
        return best

    def ids_of(self, text: str, start: int, end: int, back: list[int]) -> list[int]:
        out: list[int] = []
        while end > start:
            piece = text[end - back[end] : end]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                raw = SPACE if piece == OWN_SPACE else piece
                out += [self.bytes[b] for b in reversed(raw.encode("utf-8", "surrogatepass"))]
            end -= back[end]
        return out[::-1]

    def unit(self, text: str) -> tuple[int, bytes]:
        """Value and ids (little-endian unsigned 32-bit numbers) of one unit."""
        found = self.cache.get(text)
        if found is None:
            # pieces never hold some pairs of characters: there every path has a cut
            cuts = [] if text[1:].isalpha() else [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs]
            if cuts:
                found = self.joined([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
            else:
                found = self.best_path(text)
            if len(text) <= CACHED_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def encode(self, text: str) -> tuple[int, bytes]:
        """Value and ids of a whole text."""
        return self.joined(units(normalised(text)))

    def joined(self, parts: list[str]) -> tuple[int, bytes]:
        cache, unit = self.cache, self.unit
        found = [cache.get(x) or unit(x) for x in parts]
        return sum([x[0] for x in found]), b"".join([x[1] for x in found])

    def decoded(self, ids: bytes) -> bytes:
        """UTF-8 of the text, without the space in front."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]

    def decode(self, ids: bytes) -> str:
        return self.decoded(ids).decode("utf-8", "surrogatepass")

    def matrix(self, before: str, body: str, after: str) -> np.ndarray:
        """Transfer matrix of a chunk between the character before it and those after it."""
        n, text = len(body), body + after
        edges = edges_of(before, body)
        if not edges:
            out = np.full((STATES, STATES), NEVER, np.int64)
            for i in range(min(STATES, n + 1)):
                out[i] = self.exits(self.paths(text, i, n)[0], n)
            return out
        head = self.back_to_front(text, edges[0])
        inner = self.joined([text[a:b] for a, b in zip(edges, edges[1:])])[0]
        tail = self.exits(self.paths(text[edges[-1] :], 0, n - edges[-1])[0], n - edges[-1])
        enter = np.array([head[i] if i < len(head) else NEVER for i in range(STATES)], np.int64)
        return np.maximum(enter[:, None] + inner + tail[None, :], NEVER)

    @staticmethod
    def exits(best: list[int], n: int) -> np.ndarray:
        return np.array([best[n + j] if n + j < len(best) else NEVER for j in range(STATES)], np.int64)

    def between(self, before: str, body: str, after: str, enter: int, leave: int) -> tuple[int, bytes]:
        """Value and ids of the pieces that start in a chunk, between the states at its two cuts."""
        text, n, edges = body + after, len(body), edges_of(before, body)
        if not edges:
            best, back = self.paths(text, enter, n)
            return best[n + leave], np.array(self.ids_of(text, enter, n + leave, back), "<u4").tobytes()
        first, last = edges[0], edges[-1]
        head, back = self.paths(text[:first], enter, first)
        ids = np.array(self.ids_of(text[:first], enter, first, back), "<u4").tobytes()
        value, inner = self.joined([text[a:b] for a, b in zip(edges, edges[1:])])
        tail, back = self.paths(text[last:], 0, n - last)
        end = n - last + leave
        return head[first] + value + tail[end], ids + inner + np.array(self.ids_of(text[last:], 0, end, back), "<u4").tobytes()


def edges_of(before: str, body: str) -> list[int]:
    """Positions in a chunk where a unit starts."""
    skip = len(before)
    return [m.start() - skip for m in EDGE.finditer(before + body) if m.start() >= skip]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def normalised(text: str) -> str:
    return SPACE + (text.translate({32: SPACE, ord(SPACE): OWN_SPACE}) if SPACE in text else text.replace(" ", SPACE))


def units(text: str) -> list[str]:
    """Parts of a normalised text that start at a space after something else."""
    edges = [m.start() for m in EDGE.finditer(text)] if SPACE * 2 in text else None
    if edges is None:
        return [SPACE + x for x in text[1:].split(SPACE)] if text[:1] == SPACE else text.split(SPACE)[:1] + [SPACE + x for x in text.split(SPACE)[1:]]
    cuts = ([] if edges[:1] == [0] else [0]) + edges + [len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at the cuts between the matrices on one best path from `enter` to `leave`."""
    after = np.full(STATES, NEVER, np.int64)
    after[leave] = 0
    rest = [after]
    for m in reversed(matrices[1:]):
        rest.append(np.maximum((m + rest[-1][None, :]).max(axis=1), NEVER))
    out = [enter]
    for m, x in zip(matrices, reversed(rest)):
        out.append(int((m[out[-1]] + x).argmax()))
    return out


_RESULT = "did long, n_chars long, score long, ids binary, sha string"


def _small(path: str, chunk: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            rows = []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if len(text) <= chunk:
                    rows.append((did, len(text), *model.encode(text), None))
                if len(rows) == 512:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["did", "n_chars", "score", "ids", "sha"])

    return task


_CHUNKS = "did long, uid long, sha string, no int, before string, body string, after string"


def _cut(chunk: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in _CHUNKS.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        uid = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if len(text) <= chunk:
                    continue
                uid += 1
                sha, text, rows = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), normalised(text), []
                for no, a in enumerate(range(0, len(text), chunk)):
                    rows.append((did, uid, sha, no, text[a - 1 : a] if a else "", text[a : a + chunk], text[a + chunk : a + chunk + STATES - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return task


def _matrices(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            out = [model.matrix(*x).tobytes() for x in zip(*(batch.column(k).to_pylist() for k in ("before", "body", "after")))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("did", "uid", "no")] + [pa.array(out, pa.binary())], names=["did", "uid", "no", "m"])

    return task


def _backtrace(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            found = [model.between(*x) for x in zip(*(batch.column(k).to_pylist() for k in ("before", "body", "after", "enter", "leave")))]
            size = [len(x) for x in batch.column("body").to_pylist()]
            cols = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("did", "uid", "sha", "no")] + cols, names=["did", "uid", "sha", "no", "score", "ids", "size"])

    return task


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(STATES, STATES)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each group of a partition sorted by its first `keys` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][:keys] != row[:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _in_groups(keys: int, schema: str, rows_of):
    """A task over sorted groups; rows_of(rows) gives the rows of the result."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for rows in _groups(batches, keys):
            ready += rows_of(rows)
            if len(ready) > 4096:
                yield batch(ready)
                ready = []
        if ready:
            yield batch(ready)

    return task


def _grouped(df: DataFrame, keys: list[str], order: list[str], schema: str, rows_of) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_in_groups(len(keys), schema, rows_of), schema)


def _products(rows: list[tuple]) -> list[tuple]:
    """(uid, block, no, m) of a block: its product."""
    m = _matrix(rows[0][3])
    for row in rows[1:]:
        m = times(m, _matrix(row[3]))
    return [(rows[0][0], rows[0][1], m.tobytes())]


def _block_states(rows: list[tuple]) -> list[tuple]:
    """(uid, block, m) of a document: the states at both cuts of each block."""
    at = states([_matrix(x[2]) for x in rows], 0, 0)
    return [(x[0], x[1], i, j) for x, i, j in zip(rows, at, at[1:])]


def _chunk_states(rows: list[tuple]) -> list[tuple]:
    """(uid, block, no, m, enter, leave) of a block: the states at both cuts of each chunk."""
    at = states([_matrix(x[3]) for x in rows], rows[0][4], rows[0][5])
    return [(x[0], x[2], i, j) for x, i, j in zip(rows, at, at[1:])]


def _in_order(rows: list[tuple]) -> list[tuple]:
    """(uid, no, did, sha, score, ids, size) of a document's chunks: its row of the result."""
    sizes, scores = sum(x[6] for x in rows), sum(x[4] for x in rows)
    return [(rows[0][2], sizes - 1, scores, b"".join(x[5] for x in rows), rows[0][3])]


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """did, n_chars, score (of the best path, UNIT a bit), ids
    (little-endian unsigned 32-bit numbers) and sha (of giant documents' texts).

    A NULL text is empty, and an empty one is the single piece of the space in front; NULL doc_ids and
    repeated rows are encoded like any other; an empty table gives an empty result; other columns are
    ignored.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), "text")
    small = own.mapInArrow(_small(path, chunk), _RESULT)
    giant = own.where(F.length("text") > chunk).mapInArrow(_cut(chunk), _CHUNKS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    giant = staged(giant.repartition(parts, "uid", "no"), "chunks")  # `uid` numbers the documents from here on
    m = giant.mapInArrow(_matrices(path), "did long, uid long, no int, m binary").select("uid", "no", "m")
    m = staged(m.withColumn("block", F.floor(F.col("no") / BLOCK).cast("int")), "matrices")
    blocks = _grouped(m.select("uid", "block", "no", "m"), ["uid", "block"], ["uid", "block", "no"], "uid long, block int, m binary", _products)
    outer = _grouped(blocks, ["uid"], ["uid", "block"], "uid long, block int, enter int, leave int", _block_states)
    cells = m.select("uid", "block", "no", "m").join(outer, ["uid", "block"]).select("uid", "block", "no", "m", "enter", "leave")
    inner = _grouped(cells, ["uid", "block"], ["uid", "block", "no"], "uid long, no int, enter int, leave int", _chunk_states)
    parts = giant.join(inner, ["uid", "no"]).select("did", "uid", "sha", "no", "before", "body", "after", "enter", "leave")
    parts = parts.mapInArrow(_backtrace(path), "did long, uid long, sha string, no int, score long, ids binary, size long")
    parts = parts.select("uid", "no", "did", "sha", "score", "ids", "size")
    return small.unionByName(_grouped(parts, ["uid"], ["uid", "no"], _RESULT, _in_order))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """did, text of encoded documents (did, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            text = [model.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["did", "text"])

    return encoded.select("did", "ids").mapInArrow(task, "did long, text string")


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, score, text_sha256 (of the decoded text)."""
    names = ["doc_id", "n_chars", "n_pieces", "ids_crc32", "score", "text_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            raw = [x.as_py() for x in batch.column("ids")]
            sha = [hashlib.sha256(model.decoded(x)).hexdigest() for x in raw]
            did = [None if x == NO_ID else x for x in batch.column("did").to_pylist()]
            cols = [pa.array(did, pa.int64()), batch.column("n_chars"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), batch.column("score"), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return encoded.mapInArrow(task, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, score long, text_sha256 string")
