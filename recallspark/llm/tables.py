"""The tables the queries read, and the columns they rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.text import NO_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(did, text): a NULL doc_id sorts after all others; other columns are not carried."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("text"))


def text_key() -> Column:
    """Tells rows apart that share a doc_id (or have none) but not the text; equal rows share it."""
    return F.xxhash64("text").alias("tie")


def row_keyed(docs: DataFrame) -> DataFrame:
    """(did, tie, text): `keyed` with the hash of the text, which together name a document."""
    return keyed(docs).select("did", text_key(), "text")


def sampled(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows whose doc_id is among the first `most` of `ids` in the order of a hash: ids alone are
    sorted, and the chosen ones (at most `most` numbers, so a bounded broadcast) select the rows."""
    chosen = ids.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi")


def single(rows: DataFrame, *keys: str) -> DataFrame:
    """One row (doc_id, keys, text) an id: the text of the least hash, however often the id repeats."""
    least = F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("m")
    return rows.groupBy("doc_id", *keys).agg(least).select("doc_id", *keys, "m.text")
