"""Written tables in the shared folder of the cluster.

A staged table cuts the lineage of a DataFrame: it is written as Parquet below
`spark.checkpoint.dir` (shared by the driver and all executors) and read again, so a lost
executor costs the tasks that were running and nothing that was already written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one for a local session; a cluster
    must name one that its executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/recallspark-shared"
    return found.rstrip("/")


_written: list[str] = []  # staged tables of this application, in order


def mark() -> int:
    """A point to `discard` from."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables staged since a mark that `keep` does not read."""
    own = {f.rsplit("/", 1)[0].split(":")[-1].lstrip("/") for f in keep.inputFiles()}
    left = [path for path in _written[since:] if path.split(":")[-1].lstrip("/") in own]
    for path in set(_written[since:]).difference(left):
        _delete(spark, path)
    _written[since:] = left


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
