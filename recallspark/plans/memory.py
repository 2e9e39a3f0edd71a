"""Queries over evidence, corrections, names, runs, storage and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import names
from recallspark.operators import evidence, history, lifecycle, relational
from recallspark.plans.registry import query
from recallspark.sources import views
from recallspark.sources.staging import staged
from recallspark.sources.views import table, with_views

# --- evidence -------------------------------------------------------------------------------------

_EV = with_views("ev")
_CAND = _EV + """, c AS (SELECT evidence_id, i AS rank, json_extract(payload, '$.candidates[' || (i - 1) || ']') AS c FROM ev, range(1, 3) r(i) WHERE (payload->>'$.version')::int = 1),
cand AS (SELECT evidence_id, rank::int AS rank, (c->>'$.identity')::bigint AS identity, (c->>'$.similarity')::double AS similarity,
 list_max(list_transform(json_keys(c, '$.members'), lambda k: json_extract(c, '$.members."' || k || '"')::double)) AS best_member FROM c)
"""


@query(_EV + ", r AS (SELECT vec_id AS rep_id, label FROM embeddings) SELECT rep_id, label, evidence_id, kind FROM r JOIN ev USING (rep_id) WHERE role = 'SUBJECT'")
def evidence_of_representations(spark, d):
    ev = views.evidence(spark, d)
    reps = table(spark, d, "embeddings").select(F.col("vec_id").alias("rep_id"), "label")
    return evidence.linked(reps, ev.select("evidence_id", "rep_id", "role"), ev.select("evidence_id", "kind"), "SUBJECT").select("rep_id", "label", "evidence_id", "kind")


@query(_CAND + "SELECT evidence_id, ev.rep_id, cand.identity, cand.similarity FROM ev JOIN cand USING (evidence_id) WHERE role = 'SUBJECT' AND kind = 'RECOGNITION'")
def evidence_candidates(spark, d):
    ev = views.evidence(spark, d)
    found = evidence.candidate_rows(ev.where("kind = 'RECOGNITION'").select("evidence_id", "payload")).select("evidence_id", "identity", "similarity")
    return ev.where("role = 'SUBJECT'").select("evidence_id", "rep_id").join(found, "evidence_id").select("evidence_id", "rep_id", "identity", "similarity")


@query(_CAND + "SELECT * FROM cand")
def candidate_rows(spark, d):
    return evidence.candidate_rows(views.evidence(spark, d))


@query(_CAND + """SELECT evidence_id, 'REPEATED' AS fault FROM cand GROUP BY 1 HAVING count(*) > count(DISTINCT identity)
UNION ALL SELECT a.evidence_id, 'RISING' FROM cand a JOIN cand b ON a.evidence_id = b.evidence_id AND b.rank = 2 AND a.rank = 1 AND b.similarity > a.similarity
UNION ALL SELECT DISTINCT evidence_id, 'MEMBER' FROM cand WHERE best_member <> similarity""")
def candidate_faults(spark, d):
    return evidence.candidate_faults(evidence.candidate_rows(views.evidence(spark, d)))


@query(_CAND + """SELECT ev.evidence_id, max(similarity) FILTER (cand.identity = ev.identity_id AND rank = f.r) AS similarity, round(max(similarity) FILTER (rank = 1) - max(similarity) FILTER (rank = 2), 6) AS margin
FROM ev LEFT JOIN cand USING (evidence_id) LEFT JOIN (SELECT evidence_id, identity, min(rank) AS r FROM cand GROUP BY ALL) f ON f.evidence_id = cand.evidence_id AND f.identity = cand.identity GROUP BY 1""")
def evidence_similarity(spark, d):
    raw = F.col("payload")
    return views.evidence(spark, d).select("evidence_id", evidence.similarity_of(raw, F.col("identity_id")).alias("similarity"), F.round(evidence.margin(raw), 6).alias("margin"))


@query(_EV + """, m AS (SELECT evidence_id, json_extract(payload, '$.candidates[0].members') AS m FROM ev WHERE (payload->>'$.version')::int = 1)
SELECT evidence_id, k::bigint AS member_id, json_extract(m, '$."' || k || '"')::double AS similarity FROM (SELECT evidence_id, m, unnest(json_keys(m)) AS k FROM m)""")
def member_similarities(spark, d):
    first = F.get(evidence.payload(F.col("payload"))["candidates"], F.lit(0))["members"]
    return views.evidence(spark, d).select("evidence_id", F.explode(first).alias("k", "similarity")).select("evidence_id", F.col("k").cast("long").alias("member_id"), "similarity")


@query("""SELECT user_id AS evidence_id, '{"version":1,"candidates":[' || string_agg('{"identity":' || identity || ',"similarity":' || n || '}', ',' ORDER BY n DESC, identity) || ']}' AS payload
FROM (SELECT user_id, event_id % 5 AS identity, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def evidence_payload(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("evidence_id"), (F.col("event_id") % 5).alias("identity")).agg(F.count("*").alias("similarity"))
    order = Window.partitionBy("evidence_id").orderBy(F.desc("similarity"), "identity")
    return evidence.built(rows.withColumn("rank", F.row_number().over(order)))


@query("""WITH e AS (SELECT event_id, substr(sha256(event_type || ':' || event_id % 50), 1, 16) AS key FROM events)
SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY event_id) AS place, count(*) OVER (PARTITION BY key) AS copies FROM e""")
def evidence_by_key(spark, d):
    """Evidence under the key of its payload, numbered there; a key may hold any share of all rows."""
    key = F.substring(F.sha2(F.concat("event_type", F.lit(":"), (F.col("event_id") % 50).cast("string")).cast("binary"), 256), 1, 16)
    rows = relational.in_sequence(table(spark, d, "events").select(key.alias("key"), "event_id"), ["key", "event_id"], "n")
    first = rows.groupBy("key").agg(F.min("n").alias("first"), F.count("*").alias("copies"))
    return rows.join(first, "key").select("key", "event_id", (F.col("n") - F.col("first") + 1).alias("place"), "copies")


# --- membership -------------------------------------------------------------------------------------

_MEMBERS = """WITH o AS (SELECT o_orderkey AS occurrence_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 500 END AS rep_id FROM orders),
m AS (SELECT l_orderkey AS occurrence_id, l_partkey AS rep_id FROM lineitem)
"""


def _memberships(spark, d):
    key = F.col("o_orderkey")
    occ = table(spark, d, "orders").select(key.alias("occurrence_id"), F.when(key % 4 != 0, key % 500).alias("rep_id"))
    return occ, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("occurrence_id"), F.col("l_partkey").alias("rep_id"))


@query(_MEMBERS + "SELECT DISTINCT o.occurrence_id FROM o WHERE rep_id % 50 = 3 OR EXISTS (SELECT 1 FROM m WHERE m.occurrence_id = o.occurrence_id AND m.rep_id % 50 = 3)")
def occurrences_of_faces(spark, d):
    occ, members = _memberships(spark, d)
    wanted = occ.select("rep_id").unionByName(members.select("rep_id")).where("rep_id % 50 = 3").distinct()
    return evidence.occurrences_of(occ, members, wanted)


@query(_MEMBERS + "SELECT occurrence_id, rep_id FROM o WHERE rep_id IS NOT NULL UNION SELECT occurrence_id, rep_id FROM m")
def membership_expansion(spark, d):
    return evidence.expanded(*_memberships(spark, d))


@query(_MEMBERS + "SELECT occurrence_id, count(*) AS n, string_agg(rep_id::varchar, ',' ORDER BY rep_id) AS reps FROM (SELECT DISTINCT * FROM m) GROUP BY 1")
def occurrence_support(spark, d):
    reps = F.array_sort(F.collect_set("rep_id"))
    found = _memberships(spark, d)[1].groupBy("occurrence_id").agg(reps.alias("reps"))
    return found.select("occurrence_id", F.size("reps").cast("long").alias("n"), F.array_join(F.transform("reps", lambda x: x.cast("string")), ",").alias("reps"))


@query(_EV + """SELECT c_custkey AS identity_id FROM customer WHERE c_custkey % 7 IN (SELECT identity_id FROM ev WHERE kind IN ('CONFIRMATION', 'CORRECTION') AND rep_id % 90 = 4) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def human_decided(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("identity_id"))
    said = own.withColumn("k", F.col("identity_id") % 7).join(views.evidence(spark, d).where("rep_id % 90 = 4").select(F.col("identity_id").alias("k"), "kind").distinct(), "k")
    named = table(spark, d, "orders").select(F.col("o_custkey").alias("identity_id"), (F.col("o_orderpriority") == "2-HIGH").alias("active"))
    return evidence.human_decided(own, said, named, ("CONFIRMATION", "CORRECTION"))


# --- time ---------------------------------------------------------------------------------------------

_MS = "(epoch_us(ts) // 1000)"
_VISITS = f"""WITH v AS (SELECT user_id AS source_id, event_id % 9 AS identity_id, {_MS} AS start_ms, {_MS} + 60000 * (event_id % 30) AS end_ms, event_id AS visit_id FROM events)
"""


def _visits(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("visit_id"), F.col("user_id").alias("source_id"), (F.col("event_id") % 9).alias("identity_id"), ms.alias("start_ms"), (ms + 60000 * (F.col("event_id") % 30)).alias("end_ms"))


@query(_VISITS + "SELECT source_id, identity_id, count(*) AS visits FROM v WHERE start_ms <= 1705300000000 AND end_ms >= 1705200000000 GROUP BY ALL")
def people_between(spark, d):
    inside = history.overlapping(F.col("start_ms"), F.col("end_ms"), 1705200000000, 1705300000000)
    return _visits(spark, d).where(inside).groupBy("source_id", "identity_id").agg(F.count("*").alias("visits"))


@query(_VISITS + "SELECT visit_id FROM v WHERE start_ms BETWEEN 0 AND 1704500000000")
def history_until(spark, d):
    return _visits(spark, d).where(history.selected(F.col("visit_id"), F.col("start_ms"), until=1704500000000)).select("visit_id")


@query(_VISITS + "SELECT visit_id FROM v WHERE visit_id IN (3, 33, 333) OR start_ms >= 1706400000000")
def history_selection(spark, d):
    return _visits(spark, d).where(history.selected(F.col("visit_id"), F.col("start_ms"), [3, 33, 333], since=1706400000000)).select("visit_id")


@query(_VISITS + """, g AS (SELECT * FROM v WHERE visit_id IN (1, 2) OR (start_ms >= 1705000000000 AND identity_id = 4))
SELECT 'VISIT' AS what, visit_id AS id FROM g UNION ALL SELECT 'EVIDENCE', e.event_id FROM events e JOIN g ON g.visit_id = e.event_id - 1
UNION ALL SELECT DISTINCT 'IDENTITY', identity_id FROM g WHERE identity_id NOT IN (SELECT identity_id FROM v WHERE visit_id NOT IN (SELECT visit_id FROM g))""")
def delete_history(spark, d):
    chosen = history.selected(F.col("visit_id"), F.col("start_ms"), [1, 2], None, None) | ((F.col("start_ms") >= 1705000000000) & (F.col("identity_id") == 4))
    links = table(spark, d, "events").select(F.col("event_id").alias("evidence_id"), (F.col("event_id") - 1).alias("visit_id"))
    parts = history.deleted_history(_visits(spark, d), links, chosen)
    marked = [p.select(F.lit(w).alias("what"), F.col(c).alias("id")) for p, w, c in zip(parts, ("VISIT", "EVIDENCE", "IDENTITY"), ("visit_id", "evidence_id", "identity_id"))]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


@query(_VISITS + """, d AS (SELECT source_id, (start_ms + 3600000) // 86400000 AS day, visit_id, identity_id, start_ms FROM v)
SELECT source_id, day, count(*) AS visits, count(*) FILTER (identity_id = 8) AS unrecognised, string_agg(visit_id::varchar, ',' ORDER BY start_ms, visit_id) AS ids, (row_number() OVER (PARTITION BY source_id ORDER BY day DESC))::int AS place FROM d GROUP BY source_id, day""")
def history_by_day(spark, d):
    """Visits by local day (an hour ahead of UTC), the latest day first."""
    day = F.floor((F.col("start_ms") + 3600000) / 86400000)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "visit_id"))), lambda x: x["visit_id"].cast("string")), ",")
    days = _visits(spark, d).groupBy("source_id", day.alias("day")).agg(F.count("*").alias("visits"), F.count_if(F.col("identity_id") == 8).alias("unrecognised"), ids.alias("ids"))
    return days.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("day"))))


@query(_VISITS + "SELECT source_id, identity_id, arg_max(visit_id, (start_ms, visit_id)) AS last_visit, min(visit_id) AS first_visit FROM v GROUP BY ALL")
def people_of_source(spark, d):
    return _visits(spark, d).groupBy("source_id", "identity_id").agg(F.max_by("visit_id", F.struct("start_ms", "visit_id")).alias("last_visit"), F.min("visit_id").alias("first_visit"))


@query(_VISITS + """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY source_id, identity_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, identity_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT source_id, identity_id, run, min(start_ms) AS a, max(end_ms) AS b FROM n GROUP BY ALL)
SELECT source_id, identity_id, count(*) AS spans, sum(b - a)::bigint AS present_ms, min(a) AS first_ms, max(b) AS last_ms FROM s GROUP BY ALL""")
def presence_by_source(spark, d):
    spans = history.merged_spans(_visits(spark, d).withColumnsRenamed({"start_ms": "start", "end_ms": "end"}), ["source_id", "identity_id"])
    return spans.groupBy("source_id", "identity_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("present_ms"), F.min("start").alias("first_ms"), F.max("end").alias("last_ms"))


@query(_VISITS + """, h AS (SELECT *, start_ms // 3600000 AS hour FROM v), p AS (
 SELECT a.identity_id AS a, b.identity_id AS b, 1 AS level FROM v a JOIN v b ON a.source_id = b.source_id AND a.identity_id < b.identity_id AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms
 UNION ALL SELECT a.identity_id, b.identity_id, 2 FROM h a JOIN h b ON a.source_id = b.source_id AND a.hour = b.hour AND a.identity_id < b.identity_id
 UNION ALL SELECT a.identity_id, b.identity_id, 3 FROM v a JOIN v b ON a.source_id = b.source_id AND a.identity_id < b.identity_id AND abs(a.start_ms - b.start_ms) <= 7200000)
SELECT a, b, min(level)::int AS level FROM p GROUP BY a, b""")
def cooccurrence_levels(spark, d):
    """1 seen together, 2 in one hour of a source, 3 within two hours. Together is a join of each identity's merged spans
    in bins of their own length; an hour and its presence are counted once; of starts, only the first and last of an
    identity in two hours travel: two of one such bin are near, and of neighbouring ones the nearest two decide."""
    hour, near = 3_600_000, 7_200_000
    v = _visits(spark, d).select("source_id", "identity_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    spans = history.merged_spans(v, ["source_id", "identity_id"])
    pairs = history.overlapping_pairs(spans, spans, ["source_id"], hour).select(F.col("identity_id").alias("x"), F.col("other_identity_id").alias("y"), F.lit(1).alias("level"))
    hours = v.select("source_id", F.floor(F.col("start") / hour).alias("bin"), "identity_id").distinct()
    pairs = pairs.unionByName(hours.join(hours.withColumnRenamed("identity_id", "y"), ["source_id", "bin"]).select(F.col("identity_id").alias("x"), "y", F.lit(2).alias("level")))
    ends = v.groupBy("source_id", F.floor(F.col("start") / near).alias("bin"), "identity_id").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    other = ends.select("source_id", F.col("identity_id").alias("y"), F.col("low").alias("low2"), F.explode(F.array(F.struct(F.col("bin"), F.lit(False).alias("next")), F.struct((F.col("bin") - 1).alias("bin"), F.lit(True).alias("next")))).alias("b"))
    other = other.select("source_id", "y", "low2", "b.bin", "b.next")
    close = ends.join(other, ["source_id", "bin"]).where(~F.col("next") | (F.col("low2") - F.col("high") <= near))
    pairs = pairs.unionByName(close.select(F.col("identity_id").alias("x"), "y", F.lit(3).alias("level"))).where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("level").alias("level"))


# --- corrections, names, runs ---------------------------------------------------------------------------

_OCC = """WITH o AS (SELECT o_orderkey AS occurrence_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS identity_id, (o_orderkey % 3)::int AS revision FROM orders),
q AS (SELECT o_orderkey AS occurrence_id, CASE o_orderkey % 6 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REASSIGN' ELSE 'RESOLVE' END AS action, o_custkey - o_orderkey % 2 AS to_identity, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE (o_orderkey % 3)::int END AS asked FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 6 = 1),
j AS (SELECT o.*, action, to_identity, coalesce(CASE action WHEN 'CONFIRM' THEN identity_id IS NOT NULL WHEN 'REASSIGN' THEN identity_id IS NOT NULL AND to_identity <> identity_id ELSE identity_id IS NULL END AND asked = revision, false) AS accepted FROM o LEFT JOIN q USING (occurrence_id))
"""


@query(_OCC + """SELECT occurrence_id, CASE WHEN accepted AND action <> 'CONFIRM' THEN to_identity ELSE identity_id END AS identity_id, revision + accepted::int AS revision,
 CASE WHEN accepted THEN CASE action WHEN 'CONFIRM' THEN 'CONFIRMATION' WHEN 'REASSIGN' THEN 'CORRECTION' ELSE 'RESOLUTION' END END AS evidence_kind, accepted FROM j""")
def correct_occurrences(spark, d):
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    occ = orders.select(key.alias("occurrence_id"), F.when(key % 5 != 0, F.col("o_custkey")).alias("identity_id"), (key % 3).cast("int").alias("revision"))
    action = F.when(key % 6 == 0, "CONFIRM").when(key % 6 == 1, "REASSIGN").otherwise("RESOLVE")
    asked = F.when(key % 7 == 0, 9).otherwise((key % 3).cast("int"))
    requests = orders.where("o_orderkey % 2 = 0 or o_orderkey % 6 = 1").select(key.alias("occurrence_id"), action.alias("action"), (F.col("o_custkey") - key % 2).alias("to_identity"), asked.alias("revision"))
    return history.corrected(occ, requests)


@query(f"""WITH e AS (SELECT user_id AS identity_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'name ' || (event_id % 4) END AS name, {_MS} AS at_ms, event_id AS seq FROM events),
c AS (SELECT * FROM (SELECT *, lag(name) OVER w AS was, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY identity_id ORDER BY at_ms, seq)) WHERE n = 1 OR name IS DISTINCT FROM was),
s AS (SELECT *, lead(at_ms) OVER (PARTITION BY identity_id ORDER BY at_ms, seq) AS valid_to FROM c)
SELECT identity_id, name, at_ms AS valid_from, valid_to, valid_to IS NULL AS active FROM s WHERE name IS NOT NULL""")
def name_history(spark, d):
    events = table(spark, d, "events").select(
        F.col("user_id").alias("identity_id"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("name "), (F.col("event_id") % 4).cast("string"))).alias("name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return history.name_history(events)


_RUNS = f"""WITH r AS (SELECT event_id AS run_id, user_id AS source_id, CASE event_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS state, event_id % 4 AS base_revision, user_id % 4 AS source_revision, {_MS} AS finished_ms FROM events),
p AS (SELECT source_id, arg_max(run_id, (finished_ms, run_id)) AS run_id FROM r WHERE state = 'COMPLETED' AND base_revision = source_revision GROUP BY 1)
"""


def _runs(spark, d):
    key = F.col("event_id")
    state = F.when(key % 5 == 0, "FAILED").when(key % 5 == 1, "RUNNING").otherwise("COMPLETED")
    return table(spark, d, "events").select(
        key.alias("run_id"), F.col("user_id").alias("source_id"), state.alias("state"), (key % 4).alias("base_revision"), (F.col("user_id") % 4).alias("source_revision"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("finished_ms"))


@query(_RUNS + "SELECT source_id, run_id FROM p")
def publish_run(spark, d):
    return history.published(_runs(spark, d))


def _run_rows(spark, d):
    return _runs(spark, d).select(F.col("run_id").alias("id"), "source_id", "run_id", F.when(F.col("run_id") % 8 == 0, "ERASING").otherwise("ACTIVE").alias("state"), F.lit(1).alias("revision"))


_OLD = _RUNS + """, x AS (SELECT r.run_id AS id, r.source_id, r.run_id, CASE WHEN r.run_id % 8 = 0 THEN 'ERASING' ELSE 'ACTIVE' END AS state, coalesce(r.run_id % 8 <> 0 AND r.run_id <> p.run_id, false) AS old FROM r LEFT JOIN p USING (source_id))
"""


@query(_OLD + "SELECT id, source_id, run_id, CASE WHEN old THEN 'SUPERSEDED' ELSE state END AS state, 1 + old::int AS revision FROM x")
def supersede_previous(spark, d):
    return history.superseded(_run_rows(spark, d), history.published(_runs(spark, d)))[0]


@query(_OLD + "SELECT id AS rep_id, 'REMOVE' AS kind FROM x WHERE old")
def superseded_operations(spark, d):
    return history.superseded(_run_rows(spark, d), history.published(_runs(spark, d)))[1]


_FACES = "WITH f AS (SELECT event_id AS rep_id, CASE event_id % 4 WHEN 0 THEN 'CREATE_NEW' WHEN 1 THEN 'ABSTAIN' ELSE 'MATCH_EXISTING' END AS outcome, event_id % 50 AS identity_id FROM events), n AS (SELECT 1000000 + row_number() OVER (ORDER BY rep_id) - 1 AS identity_id, rep_id FROM f WHERE outcome = 'CREATE_NEW')\n"


def _faces(spark, d):
    key = F.col("event_id")
    outcome = F.when(key % 4 == 0, "CREATE_NEW").when(key % 4 == 1, "ABSTAIN").otherwise("MATCH_EXISTING")
    return history.created(table(spark, d, "events").select(key.alias("rep_id"), outcome.alias("outcome"), (key % 50).alias("identity_id")), 1_000_000)


@query(_FACES + "SELECT identity_id, 'ACTIVE' AS state, rep_id AS representative FROM n")
def create_identities(spark, d):
    return _faces(spark, d)[0]


@query(_FACES + "SELECT rep_id, identity_id FROM n UNION ALL SELECT rep_id, identity_id FROM f WHERE outcome = 'MATCH_EXISTING'")
def assign_faces(spark, d):
    return _faces(spark, d)[1]


@query("""WITH k AS (SELECT label AS space_id, vec_id + 1 AS ann_key FROM embeddings), n AS (SELECT event_id AS rep_id, event_id % 12 AS space_id FROM events)
SELECT rep_id, space_id, coalesce((SELECT max(ann_key) FROM k WHERE k.space_id = n.space_id), -1) + row_number() OVER (PARTITION BY space_id ORDER BY rep_id) AS ann_key FROM n""")
def allocate_keys(spark, d):
    have = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("space_id"), (F.col("vec_id") + 1).alias("ann_key"))
    new = table(spark, d, "events").select(F.col("event_id").alias("rep_id"), (F.col("event_id") % 12).alias("space_id"))
    return history.allocated(new, have, "space_id", "rep_id").select("rep_id", "space_id", "ann_key")


@query(with_views("occ") + "SELECT c_custkey AS identity_id, (SELECT arg_min(occurrence_id, (time_ms, occurrence_id)) FROM occ WHERE identity_id = c_custkey AND occurrence_id % 3 <> 0) AS representative FROM customer")
def representative_refresh(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("identity_id"))
    return history.refreshed(own, views.occurrences(spark, d).where("occurrence_id % 3 <> 0"))


@query("""SELECT p_partkey AS source_id, CASE WHEN ok THEN 'RECYCLED' ELSE state END AS state, revision + ok::int AS revision FROM (SELECT *, coalesce(state IN ('ACTIVE', 'MISSING') AND asked = revision, false) AS ok FROM
 (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'DELETING' ELSE 'ACTIVE' END AS state, (p_partkey % 3)::int AS revision, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 6 // 2)::int END AS asked FROM part))""")
def recycle_sources(spark, d):
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("source_id"), F.when(key % 4 == 0, "MISSING").when(key % 4 == 1, "DELETING").otherwise("ACTIVE").alias("state"), (key % 3).cast("int").alias("revision"))
    asked = table(spark, d, "part").where("p_partkey % 2 = 0").select(key.alias("source_id"), F.floor(key % 6 / 2).cast("int").alias("revision"))
    return history.recycled(rows, asked).select("source_id", "state", "revision")


@query("""WITH s AS (SELECT label AS space_id, vec_id AS ann_key FROM embeddings), o AS (SELECT event_id % 10 AS space_id, event_id % 700 AS ann_key, arg_max(CASE WHEN event_id % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END, event_id) AS kind FROM events GROUP BY ALL)
SELECT space_id, ann_key FROM s WHERE (space_id, ann_key) NOT IN (SELECT (space_id, ann_key) FROM o WHERE kind = 'REMOVE') UNION SELECT space_id, ann_key FROM o WHERE kind = 'ADD'""")
def apply_operations(spark, d):
    snapshot = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("space_id"), F.col("vec_id").alias("ann_key"))
    key = F.col("event_id")
    ops = table(spark, d, "events").select((key % 10).alias("space_id"), (key % 700).alias("ann_key"), F.when(key % 3 == 0, "REMOVE").otherwise("ADD").alias("kind"), key.alias("seq"))
    return history.applied(snapshot, ops)


@query(with_views("ops") + """, w AS (SELECT rep_id, bool_or(kind = 'REMOVE' AND state IN ('PENDING', 'APPLIED')) AS has, bool_or(kind = 'REMOVE' AND state = 'FAILED') AS failed FROM ops GROUP BY 1)
SELECT vec_id AS rep_id, CASE WHEN failed THEN 'REQUEUE' ELSE 'APPEND' END AS action FROM embeddings LEFT JOIN w ON rep_id = vec_id WHERE vec_id % 23 = 0 AND NOT coalesce(has, false)""")
def missing_removals(spark, d):
    """REMOVE operations that ERASING representations still need."""
    ops = views.operations(spark, d).where("kind = 'REMOVE'").groupBy("rep_id").agg(F.bool_or(F.col("state").isin("PENDING", "APPLIED")).alias("has"), F.bool_or(F.col("state") == "FAILED").alias("failed"))
    gone = views.representations(spark, d).where("state = 'ERASING'").select(F.col("id").alias("rep_id")).join(ops, "rep_id", "left").where("not coalesce(has, false)")
    return gone.select("rep_id", F.when(F.col("failed"), "REQUEUE").otherwise("APPEND").alias("action"))


@query(with_views("reps") + "SELECT DISTINCT identity_id AS space_id FROM reps WHERE state = 'ERASING' AND identity_id IS NOT NULL")
def erasing_spaces(spark, d):
    return views.representations(spark, d).where("state = 'ERASING' and identity_id is not null").select(F.col("identity_id").alias("space_id")).distinct()


@query("SELECT c_custkey AS identity_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dispose_identities(spark, d):
    """PENDING identities that nothing uses."""
    pending = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("identity_id"))
    return pending.join(table(spark, d, "orders").select(F.col("o_custkey").alias("identity_id")), "identity_id", "left_anti")


_JOBS = f"""WITH j AS (SELECT event_id AS job_id, event_id + 2 - event_id % 3 AS run_id, event_id % 2 = 0 AS video, event_id % 5 = 0 AS retried, CASE event_id % 7 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PAUSED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'CANCELLED' WHEN 5 THEN 'INTERRUPTED' ELSE 'COMPLETED' END AS state FROM events)
"""


def _jobs(spark, d):
    key = F.col("event_id")
    states = F.array(*map(F.lit, ("QUEUED", "RUNNING", "PAUSED", "FAILED", "CANCELLED", "INTERRUPTED", "COMPLETED")))
    return table(spark, d, "events").select(key.alias("job_id"), (key + 2 - key % 3).alias("run_id"), (key % 2 == 0).alias("video"), (key % 5 == 0).alias("retried"), F.get(states, (key % 7).cast("int")).alias("state"))


@query(_JOBS + """SELECT job_id, CASE WHEN state IN ('QUEUED', 'PAUSED') THEN 'CANCELLED' WHEN state = 'RUNNING' THEN 'CANCELLING' WHEN state = 'CANCELLED' THEN 'ALREADY' ELSE 'REFUSED' END AS cancel,
 CASE WHEN NOT video THEN 'REFUSED' WHEN state = 'RUNNING' THEN 'PAUSING' WHEN state = 'PAUSED' THEN 'ALREADY' ELSE 'REFUSED' END AS pause,
 CASE WHEN state NOT IN ('FAILED', 'CANCELLED', 'INTERRUPTED') THEN 'REFUSED' WHEN retried THEN 'ALREADY' WHEN video THEN 'RESUME' ELSE 'RESTART' END AS retry FROM j""")
def job_requests(spark, d):
    """What a request to cancel, pause or retry does to each job."""
    state, video = F.col("state"), F.col("video")
    cancel = F.when(state.isin("QUEUED", "PAUSED"), "CANCELLED").when(state == "RUNNING", "CANCELLING").when(state == "CANCELLED", "ALREADY").otherwise("REFUSED")
    pause = F.when(~video, "REFUSED").when(state == "RUNNING", "PAUSING").when(state == "PAUSED", "ALREADY").otherwise("REFUSED")
    retry = F.when(~state.isin("FAILED", "CANCELLED", "INTERRUPTED"), "REFUSED").when(F.col("retried"), "ALREADY").when(video, "RESUME").otherwise("RESTART")
    return _jobs(spark, d).select("job_id", cancel.alias("cancel"), pause.alias("pause"), retry.alias("retry"))


@query(_JOBS + "SELECT job_id, j.state, r.user_id AS source_id FROM j LEFT JOIN events r ON r.event_id = j.run_id AND r.event_type <> 'error'")
def jobs_with_runs(spark, d):
    runs = table(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"))
    return _jobs(spark, d).join(runs, "run_id", "left").select("job_id", "state", "source_id")


@query(_JOBS + ", x AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_id + 2 END AS run_id FROM events WHERE event_id % 9 = 0) SELECT job_id FROM (SELECT job_id, CASE WHEN job_id % 6 <> 0 THEN run_id END AS run_id FROM j) WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM x WHERE run_id IS NOT NULL)")
def jobs_outside_runs(spark, d):
    """Jobs of other runs, and those without a run: an anti join keeps NULL keys, where NOT IN would not."""
    hidden = table(spark, d, "events").where("event_id % 9 = 0").select((F.col("event_id") + 2).alias("run_id"))
    jobs = _jobs(spark, d).withColumn("run_id", F.when(F.col("job_id") % 6 != 0, F.col("run_id")))
    return jobs.join(hidden, "run_id", "left_anti").select("job_id")


@query("SELECT o_orderkey AS job_id, c_custkey AS source_id, n_name AS artifact, r_name AS store FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def job_input(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("o_orderkey").alias("job_id"), F.col("c_custkey").alias("source_id"), F.col("n_name").alias("artifact"), F.col("r_name").alias("store"))


@query("""SELECT r_name AS space, n_name AS variant, count(DISTINCT c_custkey) AS versions, count(DISTINCT s_suppkey) AS exports, count(DISTINCT p_partkey) AS components
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def configuration_tree(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    rows = rows.join(table(spark, d, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    # Names would travel with every key that is counted: a number stands for them until the counts are there.
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", F.col("r_name").alias("space"), F.col("n_name").alias("variant"))
    named = nations.groupBy("space", "variant").agg(F.min("n_nationkey").alias("place"))
    own = nations.join(named, nations["space"].eqNullSafe(named["space"]) & nations["variant"].eqNullSafe(named["variant"])).select("n_nationkey", "place").distinct()
    rows = rows.join(F.broadcast(own), F.col("c_nationkey") == F.col("n_nationkey")).select("place", "c_custkey", "l_suppkey", "l_partkey")
    # One kind of key a pass over the written rows: a task holds the keys of its split, of one kind.
    rows, counts = staged(rows, "configured"), named
    for key, name in (("c_custkey", "versions"), ("l_suppkey", "exports"), ("l_partkey", "components")):
        counts = counts.join(rows.select("place", key).distinct().groupBy("place").agg(F.count(key).alias(name)), "place")
    return counts.select("space", "variant", "versions", "exports", "components")


@query(with_views("det") + """SELECT det.id AS observation_id, 'crop-' || det.id AS artifact, c_name AS source FROM det JOIN customer ON c_custkey = det.source_id""")
def face_crops(spark, d):
    crops = views.detections(spark, d).select(F.col("id").alias("observation_id"), "source_id", F.concat(F.lit("crop-"), F.col("id").cast("string")).alias("artifact"))
    return crops.join(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source")), "source_id").select("observation_id", "artifact", "source")


@query(with_views("det") + "SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY ts, id))::int AS sequence, id AS observation_id, id % 997 AS rep_id FROM det")
def run_output(spark, d):
    """Observations and their representations in the order of each source's sequence."""
    order = Window.partitionBy("source_id").orderBy("ts", "id")
    return views.detections(spark, d).select("source_id", F.row_number().over(order).alias("sequence"), F.col("id").alias("observation_id"), (F.col("id") % 997).alias("rep_id"))


@query("SELECT s_suppkey AS source_id, s_name AS name, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_acctbal, s_suppkey LIMIT 50")
def camera_list(spark, d):
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.orderBy("s_acctbal", "s_suppkey").limit(50).select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("n_name").alias("place"))


@query(with_views("det") + "SELECT source_id, id % 11 AS track, arg_max(id, (ts, id)) AS id FROM det WHERE id % 6 <> 0 AND id % 23 <> 0 GROUP BY ALL")
def latest_track_vectors(spark, d):
    """Most recent kept face of each track that has a vector; erased ones are absent."""
    rows = views.detections(spark, d).where("id % 6 <> 0 and id % 23 <> 0")
    return rows.groupBy("source_id", (F.col("id") % 11).alias("track")).agg(F.max_by("id", F.struct("ts", "id")).alias("id"))


@query("""WITH x AS (SELECT user_id AS source_id, event_id % 40 AS track, event_id % 5 <> 0 AS matched, CASE WHEN event_id % 5 <> 0 THEN (event_id // 40) % 2 END AS identity, event_id, ts FROM events),
s AS (SELECT source_id, track, bool_and(matched) AND count(DISTINCT identity) = 1 AS settled FROM x GROUP BY ALL)
SELECT source_id, track, identity, min(event_id) AS first_face, count(*) AS faces FROM x JOIN s USING (source_id, track) WHERE settled GROUP BY ALL""")
def settled_occurrences(spark, d):
    key = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), (key % 40).alias("track"), (key % 5 != 0).alias("matched"), F.when(key % 5 != 0, F.floor(key / 40) % 2).alias("identity"), "event_id")
    one = rows.groupBy("source_id", "track").agg(F.bool_and("matched").alias("all"), F.countDistinct("identity").alias("n")).where("all and n = 1").select("source_id", "track")
    return rows.join(one, ["source_id", "track"], "left_semi").groupBy("source_id", "track", "identity").agg(F.min("event_id").alias("first_face"), F.count("*").alias("faces"))


@query("""WITH x AS (SELECT user_id AS source_id, event_id % 40 AS track, event_id % 5 <> 0 AS matched, CASE WHEN event_id % 5 <> 0 THEN (event_id // 40) % 2 END AS identity, event_id % 3 = 0 AS said FROM events)
SELECT source_id, track, (bool_and(matched) AND count(DISTINCT identity) = 1) AS settled, bool_or(said) AS recorded FROM x GROUP BY ALL HAVING (bool_and(matched) AND count(DISTINCT identity) = 1) <> bool_or(said)""")
def track_rule_violations(spark, d):
    """Tracks whose recorded proposal disagrees with the rule that all faces must name one identity."""
    key = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), (key % 40).alias("track"), (key % 5 != 0).alias("matched"), F.when(key % 5 != 0, F.floor(key / 40) % 2).alias("identity"), (key % 3 == 0).alias("said"))
    marks = rows.groupBy("source_id", "track").agg((F.bool_and("matched") & (F.countDistinct("identity") == 1)).alias("settled"), F.bool_or("said").alias("recorded"))
    return marks.where("settled <> recorded")


@query(with_views("reps", "ev") + """SELECT 'NO_EVIDENCE' AS rule, count(*) AS violations FROM reps WHERE state = 'ACTIVE' AND id NOT IN (SELECT rep_id FROM ev)
UNION ALL SELECT 'BAD_VECTOR', count(*) FROM reps WHERE len(vector) <> 64 UNION ALL SELECT 'UNKNOWN_REPRESENTATION', count(*) FROM ev WHERE rep_id NOT IN (SELECT id FROM reps)
UNION ALL SELECT 'REPEATED_KEY', count(*) FROM (SELECT ann_key FROM reps GROUP BY 1 HAVING count(*) > 1)""")
def handoff_violations(spark, d):
    """Counts of what must not be in a run that is handed over."""
    reps, ev = views.representations(spark, d), views.evidence(spark, d)
    checks = (
        ("NO_EVIDENCE", reps.where("state = 'ACTIVE'").join(ev.select(F.col("rep_id").alias("id")), "id", "left_anti")), ("BAD_VECTOR", reps.where("size(vector) <> 64")),
        ("UNKNOWN_REPRESENTATION", ev.join(reps.select(F.col("id").alias("rep_id")), "rep_id", "left_anti")), ("REPEATED_KEY", reps.groupBy("ann_key").count().where("count > 1")),
    )
    parts = [rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, rows in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- people, merging, forgetting --------------------------------------------------------------------------

_CHAIN = """WITH RECURSIVE c AS (SELECT c_custkey AS identity_id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey > 1 THEN c_custkey // 2 END AS merged_into, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer),
up AS (SELECT identity_id, identity_id AS survivor_id, merged_into FROM c UNION ALL SELECT up.identity_id, c.identity_id, c.merged_into FROM up JOIN c ON c.identity_id = up.merged_into),
f AS (SELECT identity_id, survivor_id FROM up WHERE merged_into IS NULL)
"""


def _named_chain(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("identity_id"), F.when((key % 4 != 0) & (key > 1), F.floor(key / 2)).alias("merged_into"), F.when(key % 3 == 0, F.col("c_name")).alias("name"))


@query(_CHAIN + """SELECT f.survivor_id AS identity_id, coalesce(s.name, min(c.name)) AS name, count(*) AS members, s.name IS NULL AND min(c.name) IS NOT NULL AS inherited FROM f JOIN c USING (identity_id) JOIN c s ON s.identity_id = f.survivor_id GROUP BY f.survivor_id, s.name""")
def merge_names(spark, d):
    """Names after merging: the survivor's own wins, else the first of those it takes over."""
    own = _named_chain(spark, d)
    return lifecycle.reconciled_names(own, lifecycle.family(own))


@query(_CHAIN + "SELECT c.identity_id AS loser, c.merged_into AS survivor, f.survivor_id AS final FROM c JOIN f USING (identity_id) WHERE c.merged_into IS NOT NULL")
def merge_lineage(spark, d):
    own = _named_chain(spark, d)
    final = lifecycle.family(own).select(F.col("member").alias("loser"), F.col("root").alias("final"))
    return own.where("merged_into is not null").select(F.col("identity_id").alias("loser"), F.col("merged_into").alias("survivor")).join(final, "loser")


@query(_CHAIN + """, m AS (SELECT identity_id FROM f WHERE survivor_id IN (12, 20, 44)), o AS (SELECT l_partkey AS crop_id, o_custkey AS identity_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT crop_id FROM o WHERE identity_id IN (SELECT identity_id FROM m) AND crop_id NOT IN (SELECT crop_id FROM o WHERE identity_id NOT IN (SELECT identity_id FROM m))""")
def forget_family(spark, d):
    """Crops to erase with everybody who was merged into three people."""
    chain = _named_chain(spark, d)
    family = lifecycle.family_of(chain, chain.where(F.col("identity_id").isin(12, 20, 44))).select(F.col("member").alias("identity_id"))
    return lifecycle.forget_plan(views.occurrences(spark, d).select(F.col("source_id").alias("crop_id"), "identity_id"), family)


@query(with_views("occ") + """, g AS (SELECT * FROM occ WHERE source_id % 10 = 3), s AS (SELECT * FROM occ WHERE source_id % 10 <> 3), a AS (SELECT DISTINCT identity_id FROM g)
SELECT a.identity_id, (SELECT arg_min(occurrence_id, (time_ms, occurrence_id)) FROM s WHERE s.identity_id = a.identity_id) AS representative,
 CASE WHEN a.identity_id IN (SELECT identity_id FROM s) THEN 'REPICKED' WHEN a.identity_id % 3 = 0 THEN 'KEPT_NAMED' ELSE 'DELETED' END AS outcome FROM a""")
def delete_sources(spark, d):
    """Identities that lose occurrences with deleted sources: a new representative, or gone if unnamed and empty."""
    occ = views.occurrences(spark, d)
    hit = occ.where("source_id % 10 = 3").select("identity_id").distinct()
    return lifecycle.after_delete(hit, occ.where("source_id % 10 <> 3"), F.col("identity_id") % 3 == 0)


@query("SELECT c_custkey AS identity_id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def owned_artifacts(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F' and o_custkey % 5 = 0").select(F.col("o_custkey").alias("identity_id"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("identity_id")).join(finished, "identity_id", "left_semi")
    return own.union(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("""WITH f AS (SELECT doc_id AS file_id, n_chars AS size, doc_id % 48 AS age_h FROM documents WHERE doc_id % 7 <> 0), o AS (SELECT doc_id AS file_id FROM labels UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(f.file_id, o.file_id) AS file_id, CASE WHEN o.file_id IS NULL AND age_h >= 24 THEN 'ORPHAN' WHEN o.file_id IS NULL THEN 'YOUNG' ELSE 'MISSING' END AS verdict, f.size FROM f FULL JOIN o ON f.file_id = o.file_id WHERE f.file_id IS NULL OR o.file_id IS NULL""")
def storage_scan(spark, d):
    """Files that nothing owns (after a day of grace) and owned files that are not there."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size"), (F.col("doc_id") % 48).alias("age_h"))
    owned = table(spark, d, "labels").select(F.col("doc_id").alias("file_id")).union(docs.where("file_id % 3 = 0").select("file_id")).distinct().withColumn("owned", F.lit(True))
    both = docs.where("file_id % 7 <> 0").withColumn("there", F.lit(True)).join(owned, "file_id", "full").where("there is null or owned is null")
    verdict = F.when(F.col("owned").isNull() & (F.col("age_h") >= 24), "ORPHAN").when(F.col("owned").isNull(), "YOUNG").otherwise("MISSING")
    return both.select("file_id", verdict.alias("verdict"), "size")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS digest, n_chars AS size FROM documents), f AS (SELECT doc_id + 1 AS file_id, sha256(text) AS digest, n_chars AS size FROM documents WHERE doc_id % 4 = 0)
SELECT a.doc_id, min(f.file_id) AS file_id FROM a JOIN f ON a.digest = f.digest AND a.size = f.size GROUP BY 1""")
def relink_files(spark, d):
    """Artifacts found again in other places by size and digest."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("n_chars").alias("size"))
    files = rows.where("doc_id % 4 = 0").groupBy("digest", "size").agg((F.min("doc_id") + 1).alias("file_id"))
    return rows.join(files, ["digest", "size"]).select("doc_id", "file_id")


@query("SELECT source AS folder, count(*) AS files, sum(octet_length(encode(text)))::bigint AS bytes FROM documents GROUP BY 1")
def folder_sizes(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


# --- counts, latest rows, pages ------------------------------------------------------------------------------

@query(with_views("occ") + "SELECT identity_id, count(*) AS occurrences, count(DISTINCT source_id) AS sources FROM occ JOIN part ON p_partkey = source_id WHERE p_size % 4 <> 0 GROUP BY 1")
def visible_source_counts(spark, d):
    shown = table(spark, d, "part").where("p_size % 4 <> 0").select(F.col("p_partkey").alias("source_id"))
    return views.occurrences(spark, d).join(shown, "source_id", "left_semi").groupBy("identity_id").agg(F.count("*").alias("occurrences"), F.countDistinct("source_id").alias("sources"))


@query("SELECT user_id AS run_id, max(event_id % 1000) AS ordinal, coalesce(max(event_id % 1000), -1) + 1 AS next_ordinal, arg_max(event_id, (event_id % 1000, event_id)) AS checkpoint_id FROM events GROUP BY 1")
def latest_checkpoint(spark, d):
    ordinal = F.col("event_id") % 1000
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.max(ordinal).alias("ordinal"), (F.coalesce(F.max(ordinal), F.lit(-1)) + 1).alias("next_ordinal"), F.max_by("event_id", F.struct(ordinal.alias("o"), "event_id")).alias("checkpoint_id"))


@query("SELECT key, event_id, kind FROM (SELECT event_id % 321 AS key, event_id, event_type AS kind, row_number() OVER (PARTITION BY event_id % 321 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_record(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 321).alias("key"), "event_id", F.col("event_type").alias("kind"))
    return relational.latest(rows, ["key"], [F.desc("event_id")])


_LIKE = "row_number() OVER (ORDER BY {order})"


def _paged(sql_rows: str, order: str, where: str, names_: str) -> str:
    return f"""WITH p AS (SELECT {names_} FROM {sql_rows} WHERE {where} ORDER BY {order} LIMIT 21) SELECT {names_}, position::int AS position, n > 20 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS n FROM p) WHERE position <= 20"""


@query(_paged("customer", "c_acctbal DESC, c_custkey DESC", "c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey < 9)", "c_acctbal, c_custkey"))
def identities_page(spark, d):
    return relational.page(table(spark, d, "customer").select("c_acctbal", "c_custkey"), [("c_acctbal", True), ("c_custkey", True)], 20, (5000.0, 9))


@query(_paged("customer", "c_name, c_custkey", "c_name > 'Customer#000000050' OR (c_name = 'Customer#000000050' AND c_custkey > 50)", "c_name, c_custkey"))
def people_page(spark, d):
    return relational.page(table(spark, d, "customer").select("c_name", "c_custkey"), [("c_name", False), ("c_custkey", False)], 20, ("Customer#000000050", 50))


@query(_paged("part", "p_retailprice DESC, p_partkey DESC", "p_retailprice < 1200 OR (p_retailprice = 1200 AND p_partkey < 40)", "p_retailprice, p_partkey"))
def sources_page(spark, d):
    return relational.page(table(spark, d, "part").select("p_retailprice", "p_partkey"), [("p_retailprice", True), ("p_partkey", True)], 20, (1200.0, 40))


@query(_paged("orders", "o_totalprice DESC, o_orderkey DESC", "o_totalprice < 100000 OR (o_totalprice = 100000 AND o_orderkey < 7)", "o_totalprice, o_orderkey"))
def runs_page(spark, d):
    return relational.page(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), [("o_totalprice", True), ("o_orderkey", True)], 20, (100000.0, 7))


@query(_paged("events", "event_id DESC", "event_id < 700", "event_id"))
def jobs_page(spark, d):
    return relational.page(table(spark, d, "events").select("event_id"), [("event_id", True)], 20, (700,))


@query(_paged("(SELECT event_id AS evidence_id, user_id FROM events WHERE user_id = 5)", "evidence_id", "evidence_id > 100", "evidence_id"))
def evidence_page(spark, d):
    return relational.page(table(spark, d, "events").where("user_id = 5").select(F.col("event_id").alias("evidence_id")), [("evidence_id", False)], 20, (100,))


@query(with_views("reps") + ", p AS (SELECT id, ann_key FROM reps WHERE state = 'ACTIVE' ORDER BY id LIMIT 21) SELECT id, ann_key, (row_number() OVER (ORDER BY id))::int AS position, (SELECT count(*) FROM p) > 20 AS has_more FROM p ORDER BY id LIMIT 20")
def representations_page(spark, d):
    return relational.page(views.representations(spark, d).where("state = 'ACTIVE'").select("id", "ann_key"), [("id", False)], 20)


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 30")
def transient_runs(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(30).select(F.col("o_orderkey").alias("run_id"))


@query("SELECT s_suppkey AS variant_id, s_acctbal AS created FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 ORDER BY s_acctbal DESC, s_suppkey LIMIT 25")
def variants_for_space(spark, d):
    here = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(F.broadcast(here), "s_nationkey", "left_semi").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25).select(F.col("s_suppkey").alias("variant_id"), F.col("s_acctbal").alias("created"))


@query("""SELECT s_suppkey AS variant_id, provider, (row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE provider WHEN 'gpu' THEN 0 WHEN 'npu' THEN 1 ELSE 2 END, s_suppkey))::int AS place, s_nationkey AS space_id
FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'gpu' WHEN 1 THEN 'npu' ELSE 'cpu' END AS provider FROM supplier) WHERE s_acctbal > 0""")
def perception_plan(spark, d):
    provider = F.when(F.col("s_suppkey") % 3 == 0, "gpu").when(F.col("s_suppkey") % 3 == 1, "npu").otherwise("cpu")
    rank = F.when(F.col("provider") == "gpu", 0).when(F.col("provider") == "npu", 1).otherwise(2)
    rows = table(spark, d, "supplier").where("s_acctbal > 0").withColumn("provider", provider)
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(rank, "s_suppkey"))
    return rows.select(F.col("s_suppkey").alias("variant_id"), "provider", place.alias("place"), F.col("s_nationkey").alias("space_id"))


@query("""WITH a AS (SELECT p_partkey AS package_id, sha256(p_name || p_brand) AS digest FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS package_id, sha256(CASE WHEN p_partkey % 10 = 4 THEN 'other' ELSE p_name || p_brand END) AS digest FROM part)
SELECT b.package_id, CASE WHEN a.package_id IS NULL THEN 'CREATED' WHEN a.digest = b.digest THEN 'FOUND' ELSE 'CONFLICT' END AS outcome FROM b LEFT JOIN a USING (package_id)""")
def register_packages(spark, d):
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("package_id"), F.concat("p_name", "p_brand").alias("text"))
    have = rows.where("package_id % 2 = 0").select("package_id", digest(F.col("text")).alias("have"))
    asked = rows.select("package_id", digest(F.when(F.col("package_id") % 10 == 4, "other").otherwise(F.col("text"))).alias("digest"))
    outcome = F.when(F.col("have").isNull(), "CREATED").when(F.col("have") == F.col("digest"), "FOUND").otherwise("CONFLICT")
    return asked.join(have, "package_id", "left").select("package_id", outcome.alias("outcome"))


@query("""SELECT p_partkey AS space_id, sha256('{"dimension":' || p_size || ',"metric":"' || p_brand || '"}') AS identity_key, '{"dimension":' || p_size || ',"metric":"' || p_brand || '"}' AS canonical FROM part""")
def space_identity(spark, d):
    """Canonical JSON (keys in order, no blanks) of a space's contract, and its digest."""
    row = table(spark, d, "part").select(F.col("p_partkey").alias("space_id"), names.canonical_json({"metric": F.col("p_brand"), "dimension": F.col("p_size")}).alias("canonical"))
    return row.select("space_id", F.sha2(F.col("canonical").cast("binary"), 256).alias("identity_key"), "canonical")


@query("""SELECT c_custkey, trim(regexp_replace(strip_accents(replace(c_name, '#', ' é-ß ')), '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug, lower(replace(c_name, '#', ' ')) AS same_name FROM customer""")
def name_keys(spark, d):
    name = F.replace("c_name", F.lit("#"), F.lit(" é-ß "))
    return table(spark, d, "customer").select("c_custkey", names.slug(name).alias("slug"), names.same_name_key(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("same_name"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2.0::double WHEN event_id % 3 = 1 THEN 0.5::double END AS threshold, coalesce(event_id % 3 = 1, false) AS automatic FROM events""")
def policy_modes(spark, d):
    """Threshold in a configuration's JSON, and whether it can be reached at all."""
    key = F.col("event_id")
    raw = F.when(key % 3 == 0, '{"calibration": {"mode": "off", "match_threshold": 2.0}}').when(key % 3 == 1, '{"calibration": {"mode": "on", "match_threshold": 0.5}}').otherwise("not json")
    at = F.get_json_object(raw, "$.calibration.match_threshold").cast("double")
    return table(spark, d, "events").select("event_id", at.alias("threshold"), F.coalesce(at <= 1, F.lit(False)).alias("automatic"))


@query("SELECT user_id, count(*) AS frames, count(DISTINCT floor(epoch_us(ts) / 1e6 * 0.001)) AS kept, count(*) - count(DISTINCT floor(epoch_us(ts) / 1e6 * 0.001)) AS dropped FROM events GROUP BY 1")
def dropped_frames(spark, d):
    """Frames that a source which takes the latest one of a slot leaves out."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * 0.001)
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.countDistinct(at).alias("kept"))
    return counts.withColumn("dropped", F.col("frames") - F.col("kept"))


@query(with_views("reps") + "SELECT identity_id, min(id) AS id FROM reps WHERE state = 'ERASING' AND id % 29 <> 0 AND identity_id IS NOT NULL GROUP BY 1")
def erased_faces(spark, d):
    """Erased faces of the previous generation, one an observation."""
    gone = views.snapshot(spark, d).where("state = 'ERASING' and identity_id is not null")
    return relational.latest(gone.select("identity_id", "id"), ["identity_id"], [F.asc("id")])
