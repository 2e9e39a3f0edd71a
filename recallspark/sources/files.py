"""Files as tables: imports, labelled folders, append logs, reports. Paths may be local or remote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, folder, size, modified, digest) of the files below a folder; executors read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def imported(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, artifacts) for files of a listing: a source for each, an artifact for each digest that is not
    among the known ones (digest) yet."""
    sources = files.select(F.sha2(F.col("path").cast("binary"), 256).alias("source_id"), "name", "digest", F.lit("ACTIVE").alias("state"))
    new = files.groupBy("digest").agg(F.min("path").alias("path"), F.min("size").alias("size")).join(known.select("digest"), "digest", "left_anti")
    return sources, new.select("digest", "path", "size", F.lit("AVAILABLE").alias("state"))


def labelled_folders(files: DataFrame) -> DataFrame:
    """(person, path, digest) of a folder a person."""
    return files.select(F.col("folder").alias("person"), "path", "digest")


def labelled_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, person) of an identity file: a file's name and a label on each line; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 2)
    return lines.select(F.get("p", F.lit(0)).alias("file"), F.get("p", F.lit(1)).alias("person"))


def append_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, damaged) of a JSONL file that is appended to: the records with their line, and the lines that
    are no record, `torn` if it is the last line of all (a write that was cut short)."""
    # parts of the file are told apart by where they start; inside a part the number grows in reading order
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"))
    whole = spark.read.text(path).select("value", place.alias("at"))
    rows = whole.where("trim(value) <> ''").withColumn("r", F.from_json("value", f"struct<{schema}, _bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = rows.withColumn("bad", F.col("r").isNull() | F.col("r._bad").isNotNull())
    last = rows.agg(F.max("at").alias("last"))
    good = rows.where("not bad").select("at", F.col("r").dropFields("_bad").alias("r")).select("at", "r.*")
    return good, rows.where("bad").join(F.broadcast(last)).select("at", "value", (F.col("at") == F.col("last")).alias("torn"))


def checked_log(spark: SparkSession, path: str, schema: str, version: str, known: list[int]) -> DataFrame:
    """The records of an append log that is whole: a last line that was cut short is left out, any other damage and a
    record whose `version` column is not known are refused with a ValueError."""
    good, bad = append_log(spark, path, schema)
    damaged = bad.where("not torn").count()
    strange = good.where(F.col(version).isNull() | ~F.col(version).isin(known)).count()
    if damaged or strange:
        raise ValueError(f"{path}: {damaged} damaged lines, {strange} records of an unknown version")
    return good


def report(rows: DataFrame, path: str, key: str) -> None:
    """A JSON document for each key: its rows as lines, in a folder of the key."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
