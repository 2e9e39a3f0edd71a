"""Corpus preparation: five stages over `documents`, each written as Parquet and read by the next.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of `docs`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recallspark.llm import language_id, line_dedup, packing, similar, suffix_dedup
from recallspark.llm.tables import table
from recallspark.sources.shipping import ship
from recallspark.sources.staging import discard, mark, staged


#: Bytes of a passage that repeats: fewer than those of any passage of over 50 words in the given corpora.
PASSAGE_BYTES = 240

#: Documents of an Arrow batch, unless the session says otherwise: some MB of text. Each batch is held by the JVM and by
#: Python, in every task that runs, beside what the workers have kept from earlier stages.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in. NULL texts and texts without a
    letter go; repeated rows and NULL doc_ids are judged like any other; an empty table stays empty."""
    return language_id.keep_identified(docs, language_id.train(docs, language_id.usable_rows()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; rows and NULL texts stay."""
    return line_dedup.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return similar.one_of_each(docs)


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of `PASSAGE_BYTES` bytes or more that repeat go from the texts; rows stay, NULL texts too."""
    return suffix_dedup.cut_documents(docs, PASSAGE_BYTES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; a NULL text is an empty one, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _shipped(stage):
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, BATCH_ROWS)
        return stage(ship(spark), docs, sf_dir)

    return of


STAGES = [
    ("language_id", _shipped(identify_language)),
    ("line_dedup", _shipped(drop_repeated_lines)),
    ("simhash_near_dedup", _shipped(drop_near_duplicates)),
    ("suffix_array_dedup", _shipped(cut_repeated_bytes)),
    ("packing", _shipped(pack_sequences)),
]

#: Language models, fingerprint classes and tokenizers are not expressible in SQL; tests/llm holds the operator
#: of every stage against a brute-force version or held-out labels, and each stage's result on its edge cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(spark, since, keep=docs)  # what this stage wrote on the way, and its input
    return docs
