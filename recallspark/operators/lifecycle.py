"""Identity graph: merge chains, merging, splitting, forgetting, as set-oriented transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.sources.staging import staged, unstage


def survivors(identities: DataFrame) -> DataFrame:
    """(identity_id, survivor_id) of identities (identity_id, merged_into), following merge chains by
    doubling: rounds grow with the logarithm of the longest chain. Members of a cycle keep NULL."""
    now = staged(identities.select("identity_id", F.coalesce("merged_into", "identity_id").alias("to"), F.col("merged_into").isNull().alias("end")), "chain")
    for _ in range(40):
        step = now.alias("a").join(now.alias("b"), F.col("a.to") == F.col("b.identity_id"), "left")
        after = staged(step.select(F.col("a.identity_id"), F.coalesce("b.to", "a.to").alias("to"), F.coalesce("b.end", F.lit(False)).alias("end")), "chain")
        moved = after.join(now.withColumnRenamed("to", "was"), "identity_id").where("to <> was").isEmpty()
        unstage(now)
        now = after
        if moved:
            break
    ends = identities.where("merged_into is null").select(F.col("identity_id").alias("to"))
    good = now.join(ends, "to", "left_semi").select("identity_id", F.col("to").alias("survivor_id"))
    return now.select("identity_id").join(good, "identity_id", "left")


def family(identities: DataFrame) -> DataFrame:
    """(root, member): every identity that was merged, directly or not, into each surviving one."""
    found = survivors(identities).where("survivor_id is not null")
    return found.select(F.col("survivor_id").alias("root"), F.col("identity_id").alias("member"))


def family_of(identities: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, member): each asked root (identity_id) and every identity that was merged into it, directly or through
    others. Only what the roots reach is read on, level by level; who was met is not followed again, so cycles end."""
    below = identities.where("merged_into is not null").select(F.col("merged_into").alias("member"), F.col("identity_id").alias("child"))
    key = F.col("identity_id")
    met = front = staged(roots.where("identity_id is not null").select(key.alias("root"), key.alias("member")).distinct(), "family")
    while not front.isEmpty():
        found = front.join(below, "member").select("root", F.col("child").alias("member")).distinct()
        front = staged(found.join(met, ["root", "member"], "left_anti"), "family")
        met = met.unionByName(front)
    return met


def merged(owned: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (…, identity_id) moved to the survivor of the merges (loser, survivor)."""
    to = merges.select(F.col("loser").alias("identity_id"), "survivor")
    return owned.join(to, "identity_id", "left").withColumn("identity_id", F.coalesce("survivor", "identity_id")).drop("survivor")


def split_plan(support: DataFrame, selected: DataFrame) -> DataFrame:
    """(occurrence_id, verdict) for occurrences (occurrence_id, rep_id): MOVE if all representations
    are selected, STAY if none, CONFLICT otherwise."""
    marks = support.join(selected.select("rep_id", F.lit(1).alias("hit")), "rep_id", "left")
    count = marks.groupBy("occurrence_id").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    verdict = F.when(F.col("k") == 0, "STAY").when(F.col("k") == F.col("n"), "MOVE").otherwise("CONFLICT")
    return count.select("occurrence_id", verdict.alias("verdict"))


def forget_plan(crops: DataFrame, members: DataFrame) -> DataFrame:
    """Crops (crop_id, identity_id) of the members that nobody outside shares."""
    mine = crops.join(members, "identity_id", "left_semi").select("crop_id").distinct()
    others = crops.join(members, "identity_id", "left_anti").select("crop_id").distinct()
    return mine.join(others, "crop_id", "left_anti")


def erasable(representations: DataFrame, operations: DataFrame) -> DataFrame:
    """ERASING representations with an applied REMOVE and no open operation."""
    done = operations.where("kind = 'REMOVE' and state = 'APPLIED'").select("rep_id").distinct()
    still = operations.where("state in ('PENDING', 'FAILED')").select("rep_id").distinct()
    rows = representations.where("state = 'ERASING'")
    return rows.join(done, "rep_id", "left_semi").join(still, "rep_id", "left_anti")


def reconciled_names(identities: DataFrame, families: DataFrame) -> DataFrame:
    """(identity_id, name, members, inherited) of survivors for identities (identity_id, name) and families
    (root, member): the survivor's own name wins, else the first of its members'."""
    named = families.join(identities.select(F.col("identity_id").alias("member"), "name"), "member")
    own = F.max(F.when(F.col("member") == F.col("root"), F.col("name")))
    found = named.groupBy("root").agg(own.alias("own"), F.min("name").alias("first"), F.count("*").alias("members"))
    return found.select(F.col("root").alias("identity_id"), F.coalesce("own", "first").alias("name"), "members", (F.col("own").isNull() & F.col("first").isNotNull()).alias("inherited"))


def after_delete(hit: DataFrame, surviving: DataFrame, named: Column) -> DataFrame:
    """(identity_id, representative, outcome) of identities that lost occurrences: the earliest surviving
    occurrence (identity_id, occurrence_id, time_ms) if there is one, else kept if named, else deleted."""
    first = surviving.join(hit, "identity_id", "left_semi").groupBy("identity_id").agg(F.min_by("occurrence_id", F.struct("time_ms", "occurrence_id")).alias("representative"))
    rows = hit.join(first, "identity_id", "left")
    outcome = F.when(F.col("representative").isNotNull(), "REPICKED").when(named, "KEPT_NAMED").otherwise("DELETED")
    return rows.select("identity_id", "representative", outcome.alias("outcome"))
