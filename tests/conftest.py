"""One Spark session and helpers for all tests."""

from __future__ import annotations

import math
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(x):
    """A value that compares and sorts alike from both engines."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return str(x)


def same_rows(spark_df, relation) -> None:
    """Equal names and equal bags of rows."""
    names = sorted(spark_df.columns)
    assert names == sorted(relation.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs, [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
