"""Evidence: what a recognition saw, as JSON payloads, and its links to representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Version of the payload that is read; others give NULL, never an error.
VERSION = 1
PAYLOAD = "struct<version:int,candidates:array<struct<identity:bigint,similarity:double,members:map<string,double>>>>"


def payload(raw: Column) -> Column:
    """The parsed payload; NULL if it is not JSON or of another version."""
    found = F.from_json(raw, PAYLOAD)
    return F.when(found["version"] == VERSION, found)


def similarity_of(raw: Column, identity: Column) -> Column:
    """Similarity of the candidate that is `identity`."""
    mine = F.filter(payload(raw)["candidates"], lambda c: c["identity"] == identity)
    return F.get(F.transform(mine, lambda c: c["similarity"]), F.lit(0))


def margin(raw: Column) -> Column:
    """First candidate's similarity less the second's; NULL with fewer than two."""
    scores = F.transform(payload(raw)["candidates"], lambda c: c["similarity"])
    return F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))


def built(candidates: DataFrame) -> DataFrame:
    """(evidence_id, payload) from candidates (evidence_id, rank, identity, similarity)."""
    row = F.struct("rank", F.struct("identity", "similarity").alias("c"))
    all_ = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"])
    return candidates.groupBy("evidence_id").agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), all_.alias("candidates"))).alias("payload"))


def candidate_rows(evidence: DataFrame) -> DataFrame:
    """(evidence_id, rank, identity, similarity, best_member) of payloads (evidence_id, payload)."""
    each = evidence.select("evidence_id", F.posexplode(payload(F.col("payload"))["candidates"]).alias("at", "c"))
    best = F.array_max(F.map_values("c.members"))
    return each.select("evidence_id", (F.col("at") + 1).alias("rank"), "c.identity", "c.similarity", best.alias("best_member"))


def candidate_faults(rows: DataFrame) -> DataFrame:
    """(evidence_id, fault): REPEATED identities, RISING similarities, MEMBER whose best is not the similarity."""
    before = F.lag("similarity").over(Window.partitionBy("evidence_id").orderBy("rank"))
    checked = rows.withColumn("rising", F.col("similarity") > before)
    marks = checked.groupBy("evidence_id").agg(
        (F.count("*") > F.countDistinct("identity")).alias("REPEATED"), F.bool_or(F.coalesce("rising", F.lit(False))).alias("RISING"),
        F.bool_or(F.coalesce(F.col("best_member") != F.col("similarity"), F.lit(False))).alias("MEMBER"))
    faults = F.array_compact(F.array(*(F.when(F.col(c), c) for c in ("REPEATED", "RISING", "MEMBER"))))
    return marks.select("evidence_id", F.explode(faults).alias("fault"))


def linked(representations: DataFrame, links: DataFrame, evidence: DataFrame, role: str) -> DataFrame:
    """Representations (rep_id, ...) with the evidence (evidence_id, ...) that links (evidence_id, rep_id,
    role) of one role tie them to."""
    return representations.join(links.where(F.col("role") == role).drop("role"), "rep_id").join(evidence, "evidence_id")


def occurrences_of(occurrences: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Occurrences (occurrence_id, rep_id: the representative) that a wanted representation (rep_id) stands
    for or is a member (occurrence_id, rep_id) of. Two semi-joins instead of a join on either."""
    direct = occurrences.join(wanted, "rep_id", "left_semi").select("occurrence_id")
    member = members.join(wanted, "rep_id", "left_semi").join(occurrences.select("occurrence_id"), "occurrence_id", "left_semi").select("occurrence_id")
    return direct.unionByName(member).distinct()


def expanded(occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """(occurrence_id, rep_id): members and representatives, each once."""
    own = occurrences.where("rep_id is not null").select("occurrence_id", "rep_id")
    return own.unionByName(members.select("occurrence_id", "rep_id")).distinct()


def human_decided(identities: DataFrame, evidence: DataFrame, names: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Identities (identity_id) with evidence of one of the kinds, or with an active name."""
    said = evidence.where(F.col("kind").isin(*kinds)).select("identity_id")
    named = names.where("active").select("identity_id")
    return identities.join(said.unionByName(named), "identity_id", "left_semi")
