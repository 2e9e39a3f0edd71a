"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers: a document longer than the longest tier gives whole long
windows first, and what is left goes to the smallest tier that holds it. Each tier packs its own
documents, longest first; the gap that stays in a window is filled from its own and the shorter tiers,
longest fitting piece first, and at last by cutting a shorter document where the gap ends. Windows are
therefore full, which leaves no padding. What stays at the end of a task (less than one window a tier)
is cut to falling powers of two.

Packing is done inside the tasks that tokenise: no document waits for another task and no tokens are
shuffled. Then windows of one size are dealt into step groups of `STEP` tokens over all tasks: every
group of a size costs the same, but for the last one. Only the numbers of windows by task and size are
gathered for that (tasks times sizes rows).

Tokens of a word (a part of the text between spaces) are kept in a bounded cache, as white space
separates words for this tokenizer; texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.sources.staging import staged

MOST, TIERS, STEP = 4096, (4096, 2048, 1024, 512), 32_768
#: Windows that wait in a tier before it packs, so that there is a choice of lengths.
HELD = 8
END = 2
CACHE = 1_000_000
#: Put between words that are encoded together; a word of its own.
MARK = "\x01"


class Encoder:
    """Token ids of whole texts, by words, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def learn(self, words: set[str]) -> None:
        """Encode new words. A comma or stop behind a letter or digit is a word of its own for this
        tokenizer, so the word before it is encoded once with and without."""
        stems = {w: w[:-1] for w in words if len(w) > 1 and w[-1] in ".," and w[-2].isalnum()}
        self.encode_words(sorted({*(words - stems.keys()), *stems.values(), ".", ","}.difference(self.cache)))
        for w, stem in stems.items():
            self.cache[w] = self.cache[stem] + self.cache[w[-1]]

    def encode_words(self, words: list[str]) -> None:
        """Many words in one text, told apart by the mark."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            joined = f" {MARK} ".join(part)
            if len(self.mark) != 1 or joined.count(MARK) != len(part) - 1:
                for w in part:
                    self.cache[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
                continue
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32)
            ends = (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
            raw = ids.tobytes()
            for w, a, b in zip(part, [0, *(x + 4 for x in ends)], [*ends, len(raw)]):
                self.cache[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and END."""
        cache, end = self.cache, np.uint32(END).tobytes()
        texts = [_lower(x) for x in texts]
        words = [None if any(s in x for s in self.special) else x.replace("\n", " ").split(" ") for x in texts]
        every = set().union(*(ws for ws in words if ws is not None))
        new = every.difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = every
        self.learn(new)
        out = []
        for x, ws in zip(texts, words):
            if ws is None:
                body = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                body = b"".join([cache[w] for w in ws])
            out.append(np.frombuffer(body + end, np.uint32))
        return out


def _lower(text: str) -> str:
    """The tokenizer composes characters and lower-cases; where nothing is left to compose before and
    after, lower-casing first gives the same ids and saves entries."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if is_normalized("NFC", text) and is_normalized("NFC", low) else text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, as they have most words in common."""
    return Encoder(path)


class Tier:
    """Pieces that wait in one tier, by length."""

    def __init__(self):
        self.lengths: list[tuple[int, int]] = []  # (length, number of the piece), in order
        self.tokens = 0

    def put(self, length: int, number: int) -> None:
        insort(self.lengths, (length, number))
        self.tokens += length

    def take(self, room: int) -> tuple[int, int] | None:
        """The longest piece of at most `room` tokens."""
        at = bisect_right(self.lengths, (room, 1 << 62)) - 1
        return self.pop(at) if at >= 0 else None

    def pop(self, at: int) -> tuple[int, int]:
        found = self.lengths.pop(at)
        self.tokens -= found[0]
        return found


class Tiers:
    """The tiers of a task and the windows they fill."""

    def __init__(self, first_id: int):
        self.next = first_id
        self.tiers = {t: Tier() for t in TIERS}
        self.pieces: dict[int, tuple] = {}  # number: (did, document's ids, start)
        self.count = 0
        self.made: dict[int, int] = {}  # windows by size

    def add(self, did: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Whole long windows of a document at once; the rest is routed to its tier."""
        whole = len(ids) // MOST * MOST
        for start in range(0, whole, MOST):
            yield from self.window(MOST, [(did, ids, start, MOST)])
        if whole < len(ids):
            self.route(did, ids, whole, len(ids) - whole)

    def route(self, did, ids, start: int, length: int) -> None:
        tier = min(t for t in TIERS if t >= length)
        self.tiers[tier].put(length, self.count)
        self.pieces[self.count] = (did, ids, start)
        self.count += 1

    def fill(self, size: int, tiers: list[int]) -> list[tuple]:
        """Pieces of exactly `size` tokens in all from `tiers` (own first), the last one cut if need be."""
        out, room = [], size
        while room:
            found = next((x for t in tiers if (x := self.tiers[t].take(room))), None)
            if found is None:  # nothing fits: the shortest piece is cut, its rest routed again
                length, number = self.tiers[next(t for t in reversed(tiers) if self.tiers[t].lengths)].pop(0)
                did, ids, start = self.pieces.pop(number)
                self.route(did, ids, start + room, length - room)
                out.append((did, ids, start, room))
                return out
            length, number = found
            out.append((*self.pieces.pop(number), length))
            room -= length
        return out

    def pack(self, flush: bool) -> Iterator[tuple]:
        """Windows of each tier while more than `HELD` of them wait there; at the end, all."""
        for tier in TIERS:
            own = self.tiers[tier]
            while own.tokens > (0 if flush else HELD * tier):
                tiers = [t for t in TIERS if t <= tier]
                size, have = tier, sum(self.tiers[t].tokens for t in tiers)
                while size > have:
                    size //= 2
                yield from self.window(size, self.fill(size, tiers))

    def window(self, size: int, pieces: list[tuple]) -> Iterator[tuple]:
        number, offset = self.made.get(size, 0), 0
        self.made[size] = number + 1
        for did, ids, start, length in pieces:
            yield did, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.next, offset, size, number
            offset += length
        self.next += 1


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
RESULT = ", ".join(f"{x} long" for x in _NAMES)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each piece of a document in a sequence; see RESULT.

    A NULL text is an empty one (the end token only); NULL doc_ids and repeated rows are packed like
    any other; an empty table gives an empty result; other columns are ignored. `sequence_id` holds
    the number of the task in its upper bits, `step_group` counts the groups of the windows of one size
    (`tier`).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tiers = encoder(tokenizer), Tiers(TaskContext.get().partitionId() << 40)

        def rows(found) -> Iterator[pa.RecordBatch]:
            found = list(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=_NAMES)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for did, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts)):
                    yield from rows(tiers.add(did, ids))
                yield from rows(tiers.pack(False))
        yield from rows(tiers.pack(True))

    packed = staged(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(task, RESULT), "packed")
    number, group = F.shiftright("sequence_id", 40).alias("task"), F.col("step_group")
    made = packed.groupBy(number, "tier").agg((F.max(group) + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = made.select("task", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    each = packed.withColumn("task", F.shiftright("sequence_id", 40)).join(base, ["task", "tier"])
    step = F.floor((F.col("base") + group) * F.col("tier") / F.lit(STEP))
    return each.withColumn("step_group", step).select(*_NAMES)
