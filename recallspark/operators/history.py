"""Selections over time, corrections, names with history, publication and deletion, as new rows and states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.relational import in_sequence, transition

LAST_MS = 1 << 62  # an open end


def selected(key: Column, time: Column, ids: Sequence[int] | None = None, since: int | None = None, until: int | None = None) -> Column:
    """Rows chosen by ids or by a range of milliseconds with open ends; nothing given chooses every row."""
    chosen = None
    if ids is not None:
        chosen = key.isin(*ids)
    if since is not None or until is not None:
        inside = time.between(since or 0, LAST_MS if until is None else until)
        chosen = inside if chosen is None else chosen | inside
    return F.lit(True) if chosen is None else chosen


def overlapping(start: Column, end: Column, low: int, high: int) -> Column:
    """Spans that share an instant with [low, high]."""
    return (start <= high) & (end >= low)


def corrected(occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """Occurrences (occurrence_id, identity_id, revision) after requests (occurrence_id, action, to_identity,
    revision): CONFIRM keeps the identity, REASSIGN changes it to another one, RESOLVE gives one to an
    occurrence without. A request is `accepted` if it fits the state and its revision is the row's; evidence
    of its kind is then added and the revision rises."""
    asked = requests.select("occurrence_id", "action", "to_identity", F.col("revision").alias("_asked"))
    rows = occurrences.join(asked, "occurrence_id", "left")
    has, action = F.col("identity_id").isNotNull(), F.col("action")
    fits = F.when(action == "CONFIRM", has).when(action == "REASSIGN", has & (F.col("to_identity") != F.col("identity_id"))).when(action == "RESOLVE", ~has)
    accepted = F.coalesce(fits & (F.col("revision") == F.col("_asked")), F.lit(False))
    kind = F.when(action == "CONFIRM", "CONFIRMATION").when(action == "REASSIGN", "CORRECTION").otherwise("RESOLUTION")
    rows = rows.withColumn("accepted", accepted)
    identity = F.when(F.col("accepted") & (action != "CONFIRM"), F.col("to_identity")).otherwise(F.col("identity_id"))
    return rows.select(
        "occurrence_id", identity.alias("identity_id"), (F.col("revision") + F.col("accepted").cast("int")).alias("revision"),
        F.when(F.col("accepted"), kind).alias("evidence_kind"), "accepted")


def name_history(events: DataFrame) -> DataFrame:
    """(identity_id, name, valid_from, valid_to, active) from events (identity_id, name or NULL for a removal,
    at, seq): a name holds until the next event of the identity; giving the same name again changes nothing."""
    order = Window.partitionBy("identity_id").orderBy("at", "seq")
    changed = events.withColumn("_was", F.lag("name").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    changed = changed.where("_first or not (name <=> _was)")
    spans = changed.withColumn("valid_to", F.lead("at").over(order)).where("name is not null")
    return spans.select("identity_id", "name", F.col("at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("active"))


def superseded(rows: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, operations): rows (id, source_id, run_id, state, revision) of other runs of the published
    (source_id, run_id) become SUPERSEDED at a higher revision and get a REMOVE operation."""
    joined = rows.join(published.select("source_id", F.col("run_id").alias("_new")), "source_id", "left")
    old = F.coalesce((F.col("state") == "ACTIVE") & (F.col("run_id") != F.col("_new")), F.lit(False))
    marked = joined.withColumn("_old", old)
    after = marked.select("id", "source_id", "run_id", F.when(F.col("_old"), "SUPERSEDED").otherwise(F.col("state")).alias("state"), (F.col("revision") + F.col("_old").cast("int")).alias("revision"))
    return after, marked.where("_old").select(F.col("id").alias("rep_id"), F.lit("REMOVE").alias("kind"))


def published(runs: DataFrame) -> DataFrame:
    """(source_id, run_id): the accepted run that a source shows, the latest (by finished_ms, run_id) that
    is COMPLETED and not stale (its base revision is the source's revision)."""
    fit = runs.where("state = 'COMPLETED' and base_revision = source_revision")
    return fit.groupBy("source_id").agg(F.max_by("run_id", F.struct("finished_ms", "run_id")).alias("run_id"))


def allocated(new: DataFrame, existing: DataFrame, space: str, order: str) -> DataFrame:
    """New rows with `ann_key`: numbers of each space go on behind the largest existing one."""
    most = existing.groupBy(space).agg(F.max("ann_key").alias("_most"))
    number = F.row_number().over(Window.partitionBy(space).orderBy(order))
    return new.join(most, space, "left").withColumn("ann_key", F.coalesce("_most", F.lit(-1)) + number).drop("_most")


def created(faces: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(identities, assignments) for faces (rep_id, outcome, identity_id): a new ACTIVE identity for each
    CREATE_NEW, numbered on from `first_id` in the order of rep_id; all others keep the matched one.

    Numbers are counted in two levels (see `in_sequence`), so no task takes all."""
    new = faces.where("outcome = 'CREATE_NEW'").select("rep_id")
    numbered = in_sequence(new, ["rep_id"], "identity_id", first_id)
    kept = faces.where("outcome = 'MATCH_EXISTING'").select("rep_id", "identity_id")
    return numbered.select("identity_id", F.lit("ACTIVE").alias("state"), F.col("rep_id").alias("representative")), kept.unionByName(numbered)


def refreshed(identities: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(identity_id, representative): the earliest surviving occurrence (time_ms, occurrence_id); NULL without."""
    first = occurrences.groupBy("identity_id").agg(F.min_by("occurrence_id", F.struct("time_ms", "occurrence_id")).alias("representative"))
    return identities.select("identity_id").join(first, "identity_id", "left")


def deleted_history(visits: DataFrame, evidence: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits that go, evidence that goes with them, identities left without a visit) for visits
    (visit_id, identity_id, ...) that `chosen` holds for and evidence (evidence_id, visit_id)."""
    gone, stay = visits.where(chosen), visits.where(~chosen)
    lost = gone.where("identity_id is not null").select("identity_id").distinct().join(stay, "identity_id", "left_anti")
    return gone, evidence.join(gone, "visit_id", "left_semi"), lost


def recycled(sources: DataFrame, requests: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources (key, state, revision) after requests (key, revision) to recycle them."""
    return transition(sources, requests, key, ["ACTIVE", "MISSING"], "RECYCLED")


def applied(snapshot: DataFrame, operations: DataFrame) -> DataFrame:
    """Index keys (space_id, ann_key) after operations (space_id, ann_key, kind, seq), the last one of a key
    deciding; applying them again changes nothing."""
    last = operations.groupBy("space_id", "ann_key").agg(F.max_by("kind", "seq").alias("kind"))
    kept = snapshot.select("space_id", "ann_key").join(last.where("kind = 'REMOVE'"), ["space_id", "ann_key"], "left_anti")
    return kept.unionByName(last.where("kind = 'ADD'").select("space_id", "ann_key")).distinct()


def merged_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end): union of spans (keys, start, end) that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, "start", "end").withColumn("_new", F.coalesce((F.col("start") > reach), F.lit(True)).cast("int"))
    return marked.withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def _binned(spans: DataFrame, base: int, top: int) -> DataFrame:
    """Spans (start, end, ...) in the bins, `base * 2 ** level` wide, that they touch on their own level (the first whose
    bins are longer than they are, so two bins at most) and on all above up to `top`."""
    own = F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log2((F.col("end") - F.col("start") + 1) / F.lit(float(base)))).cast("int")))
    rows = spans.withColumn("_own", own).withColumn("_level", F.explode(F.sequence("_own", F.lit(top))))
    width = F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    rows = rows.withColumn("_first", F.floor(F.col("start") / width)).withColumn("_last", F.floor(F.col("end") / width))
    return rows.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_last")


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], base: int) -> DataFrame:
    """Pairs of spans (keys, start, end, ...; ends included) of both sides with the same keys that overlap, once each; the
    right side's columns are named `other_...`.

    A pair meets on the level of its longer span: that one is in two bins there at most, and the shorter one too. So a
    long span does not fan out over every short bin, and rows before the join grow with the input times the levels.
    """
    longest = max(1, *((rows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0) for rows in (left, right)))
    top = 0
    while base << top <= longest:
        top += 1
    a = _binned(left, base, top)
    b = _binned(right.withColumnsRenamed({c: f"other_{c}" for c in right.columns if c not in keys}).withColumnsRenamed({"other_start": "start", "other_end": "end"}), base, top)
    b = b.withColumnsRenamed({"start": "other_start", "end": "other_end", "_own": "_own2", "_first": "_first2"})
    met = [*keys, "_level", "_bin"]
    longer = a.where("_level = _own").join(b, met).unionByName(a.where("_level > _own").join(b.where("_level = _own2"), met))
    real = (F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end"))
    once = F.col("_bin") == F.greatest("_first", "_first2")  # the first bin that both touch
    return longer.where(real & once).drop("_level", "_bin", "_own", "_own2", "_first", "_first2")
