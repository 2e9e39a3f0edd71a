"""Queries over evaluations, picture sets, geometry of boxes and mixed rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import boxes, stats, vectors
from recallspark.operators import pictures, retrieval
from recallspark.operators.graph import connected_components
from recallspark.plans.registry import query
from recallspark.sources import views
from recallspark.sources.views import table, with_views

# --- accuracy -----------------------------------------------------------------------------------------

_LOO = """WITH p AS (SELECT q.vec_id AS query_id, q.label AS truth, g.label AS identity, round(greatest(-1, least(1, list_dot_product(q.embedding::double[], g.embedding::double[]))), 6) AS s
 FROM embeddings q JOIN embeddings g ON g.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
b AS (SELECT query_id, truth, identity, max(s) AS best FROM p GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, identity) AS place FROM b)
"""


def _first_places(spark, d):
    reps = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("identity"), F.col("embedding").alias("vector"))
    best = retrieval.best_of_each(reps.where("id % 20 = 0").withColumnRenamed("id", "query_id"), reps)
    top = best.groupBy("query_id").agg(F.max_by("identity", F.struct("best", -F.col("identity"))).alias("identity"), F.max("best").alias("best"))
    return top.join(reps.select(F.col("id").alias("query_id"), F.col("identity").alias("truth")), "query_id")


@query(_LOO + "SELECT truth AS identity, count(*) AS queries, count(*) FILTER (identity = truth) AS found, round(avg((identity = truth)::int), 6) AS recall FROM t WHERE place = 1 GROUP BY truth")
def identity_recall(spark, d):
    hit = F.col("identity") == F.col("truth")
    return _first_places(spark, d).groupBy(F.col("truth")).agg(F.count("*").alias("queries"), F.count_if(hit).alias("found"), F.round(F.avg(hit.cast("int")), 6).alias("recall")).withColumnRenamed("truth", "identity")


@query("""WITH d AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'ACCEPT' WHEN toxic = 1 THEN 'REJECT' END AS decision FROM labels)
SELECT k.decision, count(d.decision) AS n FROM (SELECT unnest(['ACCEPT', 'REJECT', 'UNSURE', 'SKIP']) AS decision) k LEFT JOIN d ON d.decision = k.decision GROUP BY 1""")
def decision_counts(spark, d):
    """Every decision has a row, also those nobody took."""
    every = spark.createDataFrame([(x,) for x in ("ACCEPT", "REJECT", "UNSURE", "SKIP")], "decision string")
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ACCEPT").when(F.col("toxic") == 1, "REJECT")
    counts = table(spark, d, "labels").groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))
    return every.join(counts, "decision", "left").na.fill(0, ["n"])


@query("""SELECT user_id % 5 AS worker, count(*) AS turns, round(avg(value), 6) AS mean_wait, count(*) FILTER (event_type = 'purchase') AS granted, count(*) FILTER (event_type = 'error') AS refused,
 round(count(*) FILTER (event_type = 'view')::double / count(*), 6) AS background_share FROM events GROUP BY 1""")
def lease_summary(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("worker")).agg(
        F.count("*").alias("turns"), F.round(F.avg("value"), 6).alias("mean_wait"), F.count_if(kind == "purchase").alias("granted"), F.count_if(kind == "error").alias("refused"),
        F.round(F.count_if(kind == "view") / F.count("*"), 6).alias("background_share"))


@query("""WITH g AS (SELECT l_returnflag AS grp, count(*) FILTER (l_quantity > 49 AND l_linestatus = 'O') AS false_accepts, count(*) FILTER (l_linestatus = 'F')::double / count(*) AS recall FROM lineitem GROUP BY 1)
SELECT grp, false_accepts, round(recall, 6) AS recall, CASE WHEN false_accepts = 0 AND recall >= 0.5 THEN 'ENABLED' ELSE 'DISABLED' END AS verdict, CASE WHEN false_accepts = 0 AND recall >= 0.5 THEN 0.5 ELSE 2.0 END::double AS threshold FROM g""")
def final_verdict(spark, d):
    """Enabled without a false accept at enough recall; else a threshold that is never reached."""
    accepted = (F.col("l_quantity") > 49) & (F.col("l_linestatus") == "O")
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count_if(accepted).alias("false_accepts"), (F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("recall"))
    verdict, threshold = stats.verdict(F.col("false_accepts"), F.col("recall"), 0.5, 0.5)
    return g.select("grp", "false_accepts", F.round("recall", 6).alias("recall"), verdict.alias("verdict"), threshold.alias("threshold"))


# --- picture sets -----------------------------------------------------------------------------------------

_DIGESTS = """WITH f AS (SELECT source AS person, doc_id, sha256(coalesce(text, '')) AS digest FROM documents),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS n FROM f) WHERE n = 1),
o AS (SELECT person, doc_id, row_number() OVER (PARTITION BY person ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY person) AS many FROM u)
"""


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("person"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


@query(_DIGESTS + """, p AS (SELECT DISTINCT person FROM o WHERE many >= 4), c AS (SELECT person FROM p ORDER BY sha256(person) LIMIT 12)
SELECT person, doc_id, CASE WHEN place > many - greatest(1, many // 4) THEN 'QUERY' ELSE 'ENROL' END AS part FROM o JOIN c USING (person)""")
def enrolment_choice(spark, d):
    return pictures.enrolment(_files(spark, d), "person", "doc_id", "digest", 4, 12)


@query(_DIGESTS + "SELECT person, max(many) AS pictures, CASE WHEN max(many) >= 40 THEN 'KNOWN' ELSE 'UNKNOWN' END AS part FROM o GROUP BY 1")
def known_unknown(spark, d):
    counts = pictures.distinct_files(_files(spark, d), "doc_id", "digest").groupBy("person").agg(F.count("*").alias("pictures"))
    return counts.withColumn("part", F.when(F.col("pictures") >= 40, "KNOWN").otherwise("UNKNOWN"))


@query(_DIGESTS + """, s AS (SELECT f.person, count(DISTINCT f.digest) AS pictures, bool_or(g.n > 1) AS shared FROM f JOIN (SELECT digest, count(DISTINCT person) AS n FROM f GROUP BY 1) g USING (digest) GROUP BY 1)
SELECT person, CASE WHEN person IN (SELECT source FROM documents WHERE lang = 'es' AND doc_id % 400 = 7) THEN 'SAME_NAME' WHEN shared THEN 'SHARED_PICTURE' WHEN pictures < 40 THEN 'TOO_FEW' ELSE 'KEPT' END AS reason, pictures FROM s""")
def pool_people(spark, d):
    """People of a pool with the first rule that takes them out."""
    files = _files(spark, d)
    own = files.select("person", "digest").distinct()
    many = own.groupBy("digest").agg((F.count("*") > 1).alias("shared"))
    each = own.join(many, "digest").groupBy("person").agg(F.count("*").alias("pictures"), F.bool_or("shared").alias("shared"))
    twin = table(spark, d, "documents").where("lang = 'es' and doc_id % 400 = 7").select(F.col("source").alias("person")).distinct().withColumn("twin", F.lit(True))
    reason = F.when(F.col("twin"), "SAME_NAME").when(F.col("shared"), "SHARED_PICTURE").when(F.col("pictures") < 40, "TOO_FEW").otherwise("KEPT")
    return each.join(twin, "person", "left").select("person", reason.alias("reason"), "pictures")


@query("""WITH RECURSIVE f AS (SELECT source AS person, min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE source IS NOT NULL GROUP BY ALL),
o AS (SELECT person, row_number() OVER (ORDER BY sha256('sample:' || person), person) AS n, list({'d': digest, 'i': doc_id} ORDER BY doc_id) AS files FROM f GROUP BY person),
r AS (SELECT 0::BIGINT AS n, 0 AS chosen, []::VARCHAR[] AS taken, NULL::VARCHAR AS person, []::BIGINT[] AS kept
 UNION ALL SELECT n, chosen + (len(a) >= 3)::INT, CASE WHEN len(a) >= 3 THEN list_concat(taken, [x.d FOR x IN a[1:5]]) ELSE taken END, person, CASE WHEN len(a) >= 3 THEN [x.i FOR x IN a[1:5]] ELSE [] END
 FROM (SELECT o.n, r.chosen, r.taken, o.person, list_filter(o.files, lambda x: NOT list_contains(r.taken, x.d)) AS a FROM r JOIN o ON o.n = r.n + 1 WHERE r.chosen < 8))
SELECT person, unnest(kept) AS doc_id FROM r WHERE len(kept) > 0""")
def sample_people(spark, d):
    """Eight people in the order of a salted hash, at most five pictures each that nobody before them keeps."""
    return pictures.sampled(_files(spark, d), "person", "doc_id", "digest", 3, 8, 5)


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'FILE_GONE' WHEN l.doc_id % 9 = 0 THEN 'DIGEST_CHANGED' WHEN d.text IS NULL THEN 'EMPTY' WHEN toxic = 1 AND quality = 1 THEN 'CONTRADICTION' ELSE 'CURRENT' END AS reason
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 2) d ON d.doc_id = l.doc_id""")
def stale_reviews(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 13 <> 2").select("doc_id", F.lit(True).alias("there"), F.col("text").isNull().alias("empty"))
    rows = table(spark, d, "labels").join(docs, "doc_id", "left")
    reason = (F.when(F.col("there").isNull(), "FILE_GONE").when(F.col("doc_id") % 9 == 0, "DIGEST_CHANGED").when(F.col("empty"), "EMPTY")
              .when((F.col("toxic") == 1) & (F.col("quality") == 1), "CONTRADICTION").otherwise("CURRENT"))
    return rows.select("doc_id", reason.alias("reason"))


@query(with_views("det") + "SELECT id, score FROM det WHERE score >= 0.4 UNION ALL SELECT id, score FROM det WHERE score < 0.4 AND id % 3 = 0 AND score >= 0.25")
def faces_at_floor(spark, d):
    """Faces kept at another floor: those above the usual one and rejected ones above the lower."""
    rows = views.detections(spark, d).select("id", "score")
    return rows.where("score >= 0.4").unionByName(rows.where("score < 0.4 and id % 3 = 0 and score >= 0.25"))


@query("""WITH f AS (SELECT vec_id AS face_id, label, vec_id // 3 AS picture, embedding::double[] AS v FROM embeddings),
m AS (SELECT a.face_id, a.picture, a.label, b.picture AS other, max(list_dot_product(a.v, b.v)) AS best FROM f a JOIN f b ON a.label = b.label AND a.picture <> b.picture WHERE a.picture % 20 = 0 GROUP BY ALL),
s AS (SELECT label, picture, face_id, round(avg(best), 6) AS mean FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(mean) OVER w AS second FROM s WINDOW w AS (PARTITION BY label, picture ORDER BY mean DESC, face_id))
SELECT label, picture, face_id, mean FROM r WHERE place = 1 AND mean > 0.05 AND (second IS NULL OR mean > second)""")
def suggest_face(spark, d):
    """The face of a picture that fits the label's other pictures best; pictures divisible by 20 are asked for."""
    faces = table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"), F.col("label").cast("long").alias("label"), F.floor(F.col("vec_id") / 3).alias("picture"), F.col("embedding").alias("vector"))
    return pictures.suggested(faces.where("picture % 20 = 0"), faces, 0.05)


@query("""SELECT page_id, CASE WHEN octet_length(encode(html)) < 400 THEN 'TOO_SMALL' WHEN contains(lower(html), 'login') THEN 'LICENCE' ELSE 'KEPT' END AS verdict FROM pages""")
def picture_filters(spark, d):
    verdict = F.when(F.octet_length("html") < 400, "TOO_SMALL").when(F.contains(F.lower("html"), F.lit("login")), "LICENCE").otherwise("KEPT")
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"))


def _pictures(spark, d):
    """Grey values of 9 by 8 pictures: every fifth one is an earlier one with few values changed."""
    key = F.col("event_id")
    base = F.when(key % 5 == 4, key - key % 5).otherwise(key)
    grey = F.array(*(F.pmod(F.xxhash64(base, F.lit(i)), F.lit(250)) + F.when((key % 5 == 4) & (key % 72 == i), 97).otherwise(0) for i in range(72)))
    return table(spark, d, "events").select(key.alias("picture_id"), grey.alias("grey"))


@query()
def near_pictures(spark, d):
    """Pictures that stay when each is left out that is within 8 bits of one kept before it."""
    prints = _pictures(spark, d).select("picture_id", pictures.difference_hash(F.col("grey"), 9, 8).alias("bits"))
    return pictures.first_of_near(prints, 8)


# --- geometry of boxes and vectors ------------------------------------------------------------------------

@query(with_views("det") + """, b AS (SELECT *, x0 * 640 AS a0, y0 * 480 AS b0, x1 * 640 AS a1, y1 * 480 AS b1 FROM det)
SELECT id, round((a1 - a0) * (b1 - b0), 6) AS area, a0 <= 0 OR b0 <= 0 OR a1 >= 640 OR b1 >= 480 AS border, round(sqrt(pow((a0 + a1) / 2 - 320, 2) + pow((b0 + b1) / 2 - 240, 2)), 6) AS off_centre,
 x1 - x0 > 0.22 AND y1 - y0 > 0.22 AS valid, greatest(0, floor(round(a0 - (a1 - a0) * 0.5, 6)))::int AS crop_x0, greatest(0, floor(round(b0 - (b1 - b0) * 0.5, 6)))::int AS crop_y0,
 least(640, ceil(round(a1 + (a1 - a0) * 0.5, 6)))::int AS crop_x1, least(480, ceil(round(b1 + (b1 - b0) * 0.5, 6)))::int AS crop_y1 FROM b""")
def box_expressions(spark, d):
    box = [F.col(c) * n for c, n in (("x0", 640), ("y0", 480), ("x1", 640), ("y1", 480))]
    frame = [F.lit(0.0), F.lit(0.0), F.lit(640.0), F.lit(480.0)]
    cut = boxes.crop(box, F.lit(640), F.lit(480))
    return views.detections(spark, d).select(
        "id", F.round(boxes.area(box), 6).alias("area"), boxes.touches_border(box, F.lit(640), F.lit(480)).alias("border"), F.round(boxes.centre_distance(box, frame), 6).alias("off_centre"),
        boxes.valid([F.col(c) for c in ("x0", "y0", "x1", "y1")], 0.22).alias("valid"), *(c.alias(f"crop_{n}") for c, n in zip(cut, ("x0", "y0", "x1", "y1"))))


@query(with_views("det") + """, s AS (SELECT id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, least(x0 + (x1 - x0), 0.1 + 0.3) - greatest(x0, 0.1) AS iw, least(y0 + (y1 - y0), 0.2 + 0.4) - greatest(y0, 0.2) AS ih FROM det)
SELECT id, round(greatest(0, iw) * greatest(0, ih) / (w * h + 0.12 - greatest(0, iw) * greatest(0, ih)), 6) AS iou FROM s""")
def sized_overlap(spark, d):
    own = [F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")]
    return views.detections(spark, d).select("id", F.round(boxes.iou_sized(own, [F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]), 6).alias("iou"))


@query("SELECT p_partkey, greatest(1, round_even(w * least(1.0, 500.0 / greatest(w, h)), 0))::int AS width, greatest(1, round_even(h * least(1.0, 500.0 / greatest(w, h)), 0))::int AS height FROM (SELECT p_partkey, p_size * 31 AS w, p_size * 17 + p_partkey % 300 AS h FROM part)")
def scaled_frames(spark, d):
    w, h = F.col("p_size") * 31, F.col("p_size") * 17 + F.col("p_partkey") % 300
    width, height = boxes.scaled(w, h, 500)
    return table(spark, d, "part").select("p_partkey", width.alias("width"), height.alias("height"))


_POINTS = """, q AS (SELECT id, x0 + (x1 - x0) * 0.3 AS lx, x0 + (x1 - x0) * 0.7 AS rx, x0 + (x1 - x0) * (0.5 + (id % 6) / 20) AS nx, y0, x0, x1, y1 FROM det)
"""


@query(with_views("det") + _POINTS + """SELECT id, CASE WHEN id % 9 = 0 THEN 1.0 ELSE round(greatest(0.1, 1 - abs(nx - (lx + rx) / 2) / (rx - lx)), 6) END AS frontal,
 CASE WHEN id % 9 = 0 THEN 1.0 ELSE round(greatest(0, 1 - abs((nx - x0) / (x1 - x0) - 0.5) / 3 / 0.5), 6) END AS agreement FROM q""")
def landmark_factors(spark, d):
    """Frontal factor and agreement with a face whose nose is in the middle."""
    w, x = F.col("x1") - F.col("x0"), F.col("x0")
    at = lambda a, b: F.array(x + w * a, F.col("y0") + (F.col("y1") - F.col("y0")) * b)
    points = F.when(F.col("id") % 9 != 0, F.array(at(0.3, 0.4), at(0.7, 0.4), at(0.5 + F.col("id") % 6 / 20, 0.6)))
    own = boxes.shape(points, [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    straight = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.3, 0.4), (0.7, 0.4), (0.5, 0.6))))
    return views.detections(spark, d).select("id", F.round(boxes.frontal(points), 6).alias("frontal"), F.round(boxes.agreement(own, straight), 6).alias("agreement"))


@query("""SELECT vec_id, round(list_dot_product(e, e) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(e, e))), 6) AS length, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE round(e[1] / sqrt(list_dot_product(e, e)), 6) END AS head,
 round(greatest(-1, least(1, 1 - (1 - list_dot_product(e, e)))), 6) AS similarity FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)""")
def canonical_vectors(spark, d):
    """Unit vectors; NULL where a component is not finite or the length is wrong."""
    e = F.col("embedding")
    bad = F.when(F.col("vec_id") % 7 == 0, F.transform(e, lambda x: x * F.lit(float("nan")))).otherwise(e)
    unit, good = vectors.canonical(bad, 64), vectors.canonical(e, 64)
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(vectors.norm(good), 6).alias("length"), F.round(F.get(unit, F.lit(0)), 6).alias("head"), F.round(vectors.similarity(1 - vectors.dot(e, e)), 6).alias("similarity"))


# --- mixed rankings ---------------------------------------------------------------------------------------

_HITS = """WITH h AS (SELECT 'PERSON' AS type, c_custkey AS id, c_nationkey AS owner, c_acctbal AS score FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'SOURCE', p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS own, row_number() OVER (PARTITION BY type, owner ORDER BY score DESC, id) AS mine FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY own) AS place FROM r WHERE mine <= 2)
"""


@query(_HITS + "SELECT type, id, owner, (row_number() OVER (ORDER BY place, type))::int AS position, 'fused:' || type AS provenance FROM k WHERE place <= 20 ORDER BY place, type LIMIT 30")
def fused_top(spark, d):
    """Results of two types, ranked each, at most two of an owner, interleaved; each says where it is from."""
    people = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("PERSON").alias("type"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("owner"), F.col("c_acctbal").alias("score"))
    sources = table(spark, d, "part").where("p_retailprice > 0").select(F.lit("SOURCE").alias("type"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("owner"), F.col("p_retailprice").alias("score"))
    return pictures.fused(people.unionByName(sources), 2, 20, 30)


@query("""SELECT p_partkey, (row_number() OVER (ORDER BY (p_brand = 'Brand#1')::int * 2 + (p_size > 25)::int DESC, p_retailprice DESC, p_partkey))::int AS position FROM part WHERE p_retailprice > 950 ORDER BY position LIMIT 20""")
def preferred_sources(spark, d):
    """A hard constraint filters; preferences only rank."""
    wish = (F.col("p_brand") == "Brand#1").cast("int") * 2 + (F.col("p_size") > 25).cast("int")
    order = [F.desc(wish), F.desc("p_retailprice"), F.col("p_partkey")]
    best = table(spark, d, "part").where("p_retailprice > 950").orderBy(*order).limit(20)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("position"))  # over 20 rows


@query(with_views("reps", "occ") + """, a AS (SELECT DISTINCT identity_id FROM reps WHERE id % 20 = 0 AND state = 'ACTIVE' AND identity_id IS NOT NULL), n AS (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00'))
SELECT occurrence_id FROM occ WHERE identity_id IN (SELECT identity_id FROM a) AND identity_id IN (SELECT c_custkey FROM n)""")
def mixed_search(spark, d):
    """Occurrences of people that a face answers and a name matches."""
    faces = views.representations(spark, d).where("id % 20 = 0 and state = 'ACTIVE' and identity_id is not null").select(F.col("identity_id").cast("long").alias("identity_id"))
    named = table(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("00"))).select(F.col("c_custkey").alias("identity_id"))
    return views.occurrences(spark, d).join(faces, "identity_id", "left_semi").join(named, "identity_id", "left_semi").select("occurrence_id")


@query(with_views("reps") + """, p AS (SELECT q.id AS query_id, g.id, round(greatest(-1, least(1, list_dot_product(q.vector, g.vector))), 6) AS similarity FROM reps q JOIN reps g ON g.id <> q.id AND g.id % 4 = 1 AND g.state = 'ACTIVE' WHERE q.id % 20 = 0)
SELECT query_id, id, similarity, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= 5""")
def search_in_sources(spark, d):
    """Retrieval inside a scope of sources (faces of every fourth one)."""
    scope = views.representations(spark, d).where("state = 'ACTIVE' and id % 4 = 1")
    return retrieval.nearest(views.query_vectors(spark, d), scope, 5).select("query_id", "id", "similarity", "rank")


@query(with_views("reps") + """, e AS (SELECT a.id AS a, b.id AS b FROM reps a JOIN reps b ON a.id < b.id AND a.state = 'ACTIVE' AND b.state = 'ACTIVE' AND a.identity_id IS NULL AND b.identity_id IS NULL AND round(list_dot_product(a.vector, b.vector), 6) >= 0.3)
SELECT count(*) AS links, count(DISTINCT a) AS faces FROM e""")
def unknown_links(spark, d):
    """Links between unresolved faces at 0.3 or more, what `cluster_unknown` groups."""
    return _unknown_links(spark, d).agg(F.count("*").alias("links"), F.countDistinct("a").alias("faces"))


def _unknown_links(spark, d):
    rows = views.representations(spark, d).where("state = 'ACTIVE' and identity_id is null").select("id", "vector")
    return retrieval.close_pairs(rows, 0.3)


@query()
def cluster_unknown(spark, d):
    """Groups of unresolved faces before any of them is committed."""
    found = connected_components(_unknown_links(spark, d))
    rows = views.representations(spark, d).where("state = 'ACTIVE' and identity_id is null").select("id")
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster_id"))


@query("SELECT user_id AS source_id, event_id AS id, score FROM (SELECT user_id, event_id, event_id % 101 AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 101 DESC, event_id) AS n FROM events) WHERE n <= 8")
def bounded_pool(spark, d):
    """The eight best of a source; on ties the first come stay."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), (F.col("event_id") % 101).alias("score"))
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 8").drop("n")
