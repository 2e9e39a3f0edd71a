"""Suffix-array dedup over bytes: breadth-first backward extension on a Burrows-Wheeler transform.

A byte of a document (UTF-8) is removed if a string of `width` bytes that covers it also starts
anywhere else, in another document or the same; overlapping occurrences count, and strings are
judged on the input. Bytes are removed without regard to characters; `text` holds what is left,
with characters that were cut replaced by nothing. See `anchors` for the distribution and
`index.repeated_windows` for the interval expansion.

Defined results: a NULL text is empty; a NULL doc_id sorts last; rows that share doc_id and
text have the same spans; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm import index
from recallspark.llm.anchors import Windows, repeated_spans
from recallspark.llm.substring_dedup import merged, with_spans
from recallspark.llm.tables import row_keyed, text_key
from recallspark.llm.text import NO_ID

WIDTH = 400

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _apply(texts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1), batch.column(2)):
                raw = (body.as_py() or "").encode()
                cut, at, left = merged(spans.as_py(), len(raw)), 0, []
                for a, b in cut:
                    left.append(raw[at:a])
                    at = b
                left = b"".join([*left, raw[at:]]) if cut else raw
                rows.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if texts else None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return task


def byte_windows(width: int = WIDTH) -> Windows:
    run = max(1, min(256, width * 16 // 25))
    return Windows("byte", width, width - run + 1, tuple(x for x in (32, 4) if x < run) + (1,), False, index.repeated_windows)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with `texts`) the text that is left."""
    own = row_keyed(docs)
    return with_spans(own, repeated_spans(own, byte_windows(width))).mapInArrow(_apply(texts), RESULT)


def cut_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, with repeated bytes cut from the text; n_chars is counted again."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")
    each = repeated_spans(row_keyed(docs), byte_windows(width)).groupBy("did", "tie").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = docs.select(did, text_key(), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).join(each, ["did", "tie"], "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for body, cut in zip(text, spans):
            if body is not None and cut is not None and len(cut):
                raw, at, left = body.encode(), 0, []
                for a, b in merged(list(cut), len(raw)):
                    left.append(raw[at:a])
                    at = b
                body = b"".join([*left, raw[at:]]).decode("utf-8", "ignore")
            out.append(body)
        return pd.Series(out, dtype=object)

    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    rows = rows.withColumn("kept", F.when(F.col("spans").isNull(), at["text"]).otherwise(kept(at["text"], "spans")))
    at["text"] = F.col("kept")
    if "n_chars" in at:
        at["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(x.alias(c) for c, x in at.items()))
