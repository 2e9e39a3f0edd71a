"""Substring dedup over words: FM-indexes of bounded shards, backward search, matching statistics.

Words are maximal runs of bytes other than space and 0x09-0x0D. A window is `width` consecutive
words of one document; a word is removed if a window that covers it has a word sequence that also
starts earlier (smaller doc_id, or the same document and an earlier start; different texts of one
doc_id or without any are documents of their own, ordered by their hash). Windows are judged on
the input. See `anchors` for the distribution and `index.earlier_windows` for the search.

Defined results: a NULL text has no words; a NULL doc_id sorts last; rows that share doc_id and text
are one document's repeats, get the same spans and do not count as earlier than each other; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import index
from recallspark.llm.anchors import Windows, repeated_spans
from recallspark.llm.tables import row_keyed

WIDTH = 20

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def merged(spans: list | None, most: int) -> list[tuple[int, int]]:
    """Union of the spans, in order, within [0, most)."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], min(x["b"], most)) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans): each document with its array of spans, NULL if it has none."""
    each = spans.groupBy("did", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(each, ["did", "tie"], "left").select(F.when(F.col("did") != F.lit((1 << 63) - 1), F.col("did")).alias("doc_id"), "text", "spans")


def _apply(texts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, gone, sha, kept = [], [], [], []
            for body, spans in zip(batch.column(1), batch.column(2)):
                words = (body.as_py() or "").encode().split()
                cut, at, left = merged(spans.as_py(), len(words)), 0, []
                for a, b in cut:
                    left += words[at:a]
                    at = b
                left = b" ".join(left + words[at:] if cut else words)
                many.append(len(words))
                gone.append(sum(b - a for a, b in cut))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if texts else None)
            cols = [batch.column(0), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return task


def word_windows(width: int = WIDTH) -> Windows:
    run = max(1, width * 4 // 5)
    return Windows("word", width, width - run + 1, (4, 1) if run > 4 else (1,), True, index.earlier_windows)


def substring_dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with `texts`) the kept words joined by a space."""
    own = row_keyed(docs)
    return with_spans(own, repeated_spans(own, word_windows(width))).mapInArrow(_apply(texts), RESULT)
