"""The model's tables as views of the given ones, by integer arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("ann_key"),
        F.when(F.col("vec_id") % 17 != 0, F.col("label")).alias("identity_id"),
        F.expr("CASE WHEN vec_id % 23 = 0 THEN 'ERASING' WHEN vec_id % 11 = 0 THEN 'PENDING' ELSE 'ACTIVE' END").alias("state"),
        F.col("embedding").alias("vector"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the derived index holds: some representations are missing, erased ones are stale."""
    return representations(spark, sf_dir).where("id % 29 <> 0")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of every search: ids divisible by 20."""
    rows = representations(spark, sf_dir).where("id % 20 = 0")
    return rows.select(F.col("id").alias("query_id"), "vector", (F.floor(F.col("id") / 20) % 10 / 10).alias("detection_score"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("identity_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time_ms"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("source_id"), "l_linenumber")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occurrence_id"), "identity_id", "source_id", "time_ms")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_of(table(spark, sf_dir, "events"))


def detections_of(e: DataFrame) -> DataFrame:
    """The same of events that are a stream."""
    x0, y0 = (F.col("event_id") % 7) / 10, (F.col("event_id") % 5) / 10
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), "ts", x0.alias("x0"), y0.alias("y0"),
        (x0 + 0.2 + (F.col("event_id") % 3) / 20).alias("x1"), (y0 + 0.3 + (F.col("event_id") % 2) / 20).alias("y1"),
        ((F.col("event_id") % 101) / 100).alias("score"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index operations and jobs share the events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 997).alias("rep_id"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END").alias("kind"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'FAILED' WHEN event_id % 4 = 0 THEN 'PENDING' ELSE 'APPLIED' END").alias("state"),
        (F.col("event_id") % 5).cast("int").alias("attempts"), (F.col("event_id") % 6 != 1).alias("ok"), (F.col("event_id") % 5).alias("priority"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_ms"), F.col("user_id").alias("run_id"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with a JSON payload of two candidates; one in ten has a version that nobody reads."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("evidence_id"), (F.col("event_id") % 997).alias("rep_id"), (F.col("event_id") % 7).alias("identity_id"), "ts",
        F.expr("CASE event_id % 6 WHEN 0 THEN 'CONFIRMATION' WHEN 1 THEN 'CORRECTION' ELSE 'RECOGNITION' END").alias("kind"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'NEIGHBOUR' ELSE 'CONTEXT' END").alias("role"),
        F.expr(PAYLOAD).alias("payload"),
    )


#: JSON of an event's payload, in expressions that both engines read alike.
PAYLOAD = """concat('{"version": ', CASE WHEN event_id % 10 = 9 THEN '2' ELSE '1' END, ', "candidates": [{"identity": ', CAST(event_id % 7 AS STRING), ', "similarity": 0.',
 CAST(500 + event_id % 400 AS STRING), ', "members": {"', CAST(event_id % 13 AS STRING), '": 0.', CAST(500 + event_id % 400 AS STRING), ', "', CAST(13 + event_id % 11 AS STRING), '": 0.', CAST(450 + event_id % 40 AS STRING), '}}, {"identity": ',
 CAST((event_id + event_id % 3) % 7 AS STRING), ', "similarity": 0.', CAST(480 + event_id % 380 AS STRING), ', "members": {"', CAST(event_id % 17 AS STRING), '": 0.', CAST(470 + event_id % 390 AS STRING), '}}]}')"""


#: The same views for DuckDB.
SQL = {
    "ev": f"""ev AS (SELECT event_id AS evidence_id, event_id % 997 AS rep_id, event_id % 7 AS identity_id, ts, CASE event_id % 6 WHEN 0 THEN 'CONFIRMATION' WHEN 1 THEN 'CORRECTION' ELSE 'RECOGNITION' END AS kind,
 CASE event_id % 3 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'NEIGHBOUR' ELSE 'CONTEXT' END AS role, {PAYLOAD} AS payload FROM events)""",
    "reps": """reps AS (SELECT vec_id AS id, vec_id + 1 AS ann_key, CASE WHEN vec_id % 17 <> 0 THEN label END AS identity_id,
 CASE WHEN vec_id % 23 = 0 THEN 'ERASING' WHEN vec_id % 11 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS state, embedding::double[] AS vector FROM embeddings)""",
    "occ": """occ AS (SELECT l_orderkey * 10 + l_linenumber AS occurrence_id, o_custkey AS identity_id, l_partkey AS source_id, epoch_ms(o_orderdate) AS time_ms
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "det": """det AS (SELECT event_id AS id, user_id AS source_id, ts, (event_id % 7) / 10 AS x0, (event_id % 5) / 10 AS y0,
 (event_id % 7) / 10 + 0.2::double + (event_id % 3) / 20 AS x1, (event_id % 5) / 10 + 0.3::double + (event_id % 2) / 20 AS y1, (event_id % 101) / 100 AS score FROM events)""",
    "ops": """ops AS (SELECT event_id AS seq, event_id % 997 AS rep_id, CASE WHEN event_id % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END AS kind,
 CASE WHEN event_id % 7 = 0 THEN 'FAILED' WHEN event_id % 4 = 0 THEN 'PENDING' ELSE 'APPLIED' END AS state, (event_id % 5)::int AS attempts, event_id % 6 <> 1 AS ok,
 event_id % 5 AS priority, (epoch_us(ts) // 1000) AS created_ms, user_id AS run_id FROM events)""",
    "knn": """pairs AS (SELECT q.id AS query_id, g.id, g.identity_id, g.state, round(greatest(-1, least(1, list_dot_product(q.vector, g.vector))), 6) AS similarity
 FROM reps q JOIN reps g ON g.id % 29 <> 0 WHERE q.id % 20 = 0 AND g.id <> q.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs)""",
    "shortlist": """fetched AS (SELECT * FROM ranked WHERE rank <= 10),
short AS (SELECT * FROM fetched WHERE state = 'ACTIVE'),
status AS (SELECT query_id, count(*) AS fetched, count(*) FILTER (state = 'ACTIVE') AS kept, count(*) FILTER (state <> 'ACTIVE') AS dropped FROM fetched GROUP BY query_id)""",
    "groups": """grp AS (SELECT query_id, identity_id, max(similarity) AS best, count(*) AS members, arg_min(id, (-similarity, id)) AS first_id
 FROM short GROUP BY query_id, identity_id, CASE WHEN identity_id IS NULL THEN id END),
groups AS (SELECT *, row_number() OVER w AS group_rank, round(best - lead(best) OVER w, 6) AS margin FROM grp WINDOW w AS (PARTITION BY query_id ORDER BY best DESC, first_id))""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
