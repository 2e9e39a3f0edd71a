"""Families of asked roots, landmarks laid on a template, change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import boxes, names
from recallspark.operators import lifecycle, relational
from recallspark.plans.registry import query
from recallspark.sources import views
from recallspark.sources.views import table, with_views

#: Where the five landmarks of a face lie in a picture of 112 by 112.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS identity_id, CASE WHEN c_custkey = 20 THEN 41 WHEN c_custkey % 4 <> 0 AND c_custkey > 1 THEN c_custkey // 2 END AS merged_into FROM customer),
f AS (SELECT identity_id AS root, identity_id AS member FROM c WHERE identity_id IN (12, 20, 44) UNION SELECT f.root, c.identity_id FROM f JOIN c ON c.merged_into = f.member)
SELECT root, member FROM f""")
def family_of_roots(spark, d):
    """Everybody who was merged into three identities, of which one lies on a cycle."""
    key = F.col("c_custkey")
    chain = table(spark, d, "customer").select(key.alias("identity_id"), F.when(key == 20, 41).when((key % 4 != 0) & (key > 1), F.floor(key / 2)).alias("merged_into"))
    return lifecycle.family_of(chain, chain.where(F.col("identity_id").isin(12, 20, 44)))


_POINTS = "CASE WHEN id % 50 = 7 THEN 0.5 ELSE x0 + (x1 - x0) * (0.2 + (id % (7 + k)) / 10.0) END AS x, CASE WHEN id % 50 = 7 THEN 0.5 ELSE y0 + (y1 - y0) * (0.1 + (id % (11 + k)) / 13.0) END AS y"


@query(with_views("det") + f""", t AS (SELECT * FROM (VALUES {', '.join(f"({k}, {u}::DOUBLE, {v}::DOUBLE)" for k, (u, v) in enumerate(TEMPLATE))}) AS t(k, u, v)),
p AS (SELECT id, k, u, v, {_POINTS} FROM det, t),
m AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) + covar_pop(y, y) AS size,
 covar_pop(x, u) + covar_pop(y, v) AS a, covar_pop(x, v) - covar_pop(y, u) AS b FROM p GROUP BY id),
f AS (SELECT *, size >= 1e-12 AS fit FROM m)
SELECT id, CASE WHEN fit THEN round(a / size, 3) END AS turn_x, CASE WHEN fit THEN round(b / size, 3) END AS turn_y,
 CASE WHEN fit THEN round(mu - a / size * mx + b / size * my, 3) END AS shift_x, CASE WHEN fit THEN round(mv - b / size * mx - a / size * my, 3) END AS shift_y FROM f""")
def aligned_landmarks(spark, d):
    """The transform that lays five landmarks of a face on the template; none if they are one point."""
    det = views.detections(spark, d)
    x0, y0, w, h, key = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("id")
    one = key % 50 == 7
    point = lambda k: F.array(F.when(one, 0.5).otherwise(x0 + w * (0.2 + key % (7 + k) / 10)), F.when(one, 0.5).otherwise(y0 + h * (0.1 + key % (11 + k) / 13)))
    target = F.array(*(F.array(F.lit(u), F.lit(v)) for u, v in TEMPLATE))
    m = boxes.similarity_transform(F.array(*(point(k) for k in range(5))), target)
    at = lambda i, j: F.round(F.get(F.get(m, F.lit(i)), F.lit(j)), 3)
    return det.select("id", at(0, 0).alias("turn_x"), at(1, 0).alias("turn_y"), at(0, 2).alias("shift_x"), at(1, 2).alias("shift_y"))


_SNAPSHOTS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
a AS (SELECT * FROM o WHERE k % 10 <> 3), b AS (SELECT k, cust, CASE WHEN k % 4 = 0 THEN 'X' ELSE status END AS status, CASE WHEN k % 6 = 0 THEN NULL ELSE priority END AS priority FROM o WHERE k % 10 <> 7),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS fresh, b.k IS NULL AS gone, a.cust IS DISTINCT FROM b.cust AS c1, a.status IS DISTINCT FROM b.status AS c2, a.priority IS DISTINCT FROM b.priority AS c3, b.cust, b.status, b.priority FROM a FULL JOIN b ON a.k = b.k)
"""


@query(_SNAPSHOTS + """SELECT row_number() OVER (ORDER BY k) AS sequence, CASE WHEN fresh THEN 'INSERT' WHEN gone THEN 'DELETE' ELSE 'UPDATE' END AS kind, k AS order_id,
 CASE WHEN fresh OR gone THEN '' ELSE concat_ws(',', CASE WHEN c1 THEN 'cust' END, CASE WHEN c2 THEN 'status' END, CASE WHEN c3 THEN 'priority' END) END AS changed, status FROM j WHERE fresh OR gone OR c1 OR c2 OR c3""")
def change_feed(spark, d):
    """What two snapshots of the orders differ in, as a numbered feed."""
    old, new = snapshots(spark, d)
    feed = relational.changes(old, new, "order_id")
    return feed.select("sequence", "kind", "order_id", F.array_join("changed", ",").alias("changed"), F.col("data.status").alias("status"))


def snapshots(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("order_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    late = rows.where("order_id % 10 <> 7").withColumn("status", F.when(F.col("order_id") % 4 == 0, "X").otherwise(F.col("status")))
    return rows.where("order_id % 10 <> 3"), late.withColumn("priority", F.when(F.col("order_id") % 6 != 0, F.col("priority")))


_NAMED = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
_RANK = "CASE WHEN name = 'er' THEN 0 WHEN starts_with(name, 'er') THEN 1 WHEN contains(name, 'er') THEN 2 END"


@query(with_views("occ") + f""", c AS (SELECT 'PERSON' AS kind, c_custkey AS id, lower(trim(c_name)) AS name FROM customer WHERE {_NAMED}
 UNION ALL SELECT 'IDENTITY', c_custkey, 'person ' || substr(sha256(c_custkey::VARCHAR), 1, 6) FROM customer WHERE NOT {_NAMED}
 UNION ALL SELECT 'SOURCE', p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) FROM part),
r AS (SELECT *, {_RANK} AS rank FROM c), n AS (SELECT kind, id, name, rank, row_number() OVER (PARTITION BY kind ORDER BY rank, name, id) AS position FROM r WHERE rank IS NOT NULL QUALIFY position <= 15),
o AS (SELECT 'OCCURRENCE' AS kind, occurrence_id AS id, NULL::VARCHAR AS name, NULL::INT AS rank, row_number() OVER (ORDER BY time_ms DESC, occurrence_id DESC) AS position
      FROM occ WHERE identity_id IN (SELECT id FROM n WHERE kind IN ('PERSON', 'IDENTITY')) QUALIFY position <= 15)
SELECT kind, id, name, rank::INT AS rank, position::INT AS position, 'er' AS query, 'NAME_LOOKUP' AS plan, 'PERSON,IDENTITY,SOURCE,OCCURRENCE' AS kinds, total, processed
FROM (SELECT * FROM n UNION ALL SELECT * FROM o), (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed FROM orders)""")
def search_names(spark, d):
    """People, unnamed identities, sources and their newest occurrences for one text, with coverage and plan."""
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name"))
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    people = who.join(urgent, "id", "left_semi").select("id", names.normalised(F.col("c_name")).alias("name"))
    label = names.short_label(F.sha2(F.col("id").cast("string").cast("binary"), 256))
    unnamed = who.join(urgent, "id", "left_anti").select("id", names.normalised(label).alias("name"))
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.normalised(F.col("p_name")).alias("name"))
    occurrences = views.occurrences(spark, d).select(F.col("occurrence_id").alias("id"), "identity_id", "time_ms")
    coverage = table(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))
    return relational.name_search(" ER ", people, unnamed, sources, occurrences, coverage, ("PERSON", "IDENTITY", "SOURCE", "OCCURRENCE"), 15)
