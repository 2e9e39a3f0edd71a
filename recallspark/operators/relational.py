"""Ranking, paging, counting and guarded transitions over entity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.names import match_rank
from recallspark.sources.staging import staged


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the order given; one exchange on the key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def page(rows: DataFrame, order: Sequence[tuple[str, bool]], size: int, after: Sequence | None = None) -> DataFrame:
    """Keyset page: `size` rows behind the cursor, with has_more from one row beyond.

    order: (column, descending), the last one unique; after: the cursor's values.
    """
    if after is not None:
        where, same = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after):
            here = F.col(name) < F.lit(value) if down else F.col(name) > F.lit(value)
            where, same = where | (same & here), same & (F.col(name) == F.lit(value))
        rows = rows.where(where)
    sort = [F.desc(c) if down else F.asc(c) for c, down in order]
    probe = rows.orderBy(*sort).limit(size + 1)
    number = F.row_number().over(Window.orderBy(*sort))  # over size + 1 rows
    probe = probe.withColumn("position", number).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return probe.where(F.col("position") <= size)


def running_sums(rows: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], descending: bool = False, width: float = 1e-3) -> DataFrame:
    """Rows (keys, order, ...; `order` once a key) with `sums` summed from the first value of `order` on.

    In two levels: totals of buckets of `order`, `width` wide, are summed first (as many rows as there are
    buckets, however many rows there are); inside a bucket its rows follow. No task takes all of a key."""
    bucket = F.floor(F.col(order) / width)
    way = F.desc if descending else F.asc
    at = rows.withColumn("_bucket", bucket)
    totals = at.groupBy(*keys, "_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(way(order))
    own = at.withColumns({c: F.sum(c).over(inside) for c in sums})
    joined = own.join(base, [*keys, "_bucket"])
    return joined.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_bucket", *(f"_{c}" for c in sums))


def best_point(sweep: DataFrame, known: DataFrame, accepted: int, precision: float, recall: float) -> DataFrame:
    """Of a sweep (margin, threshold, accepted, correct) the point with the highest recall (of `known` queries, one row)
    among those that reach three limits; the lowest threshold, then margin, of several. None may reach them."""
    fit = sweep.where((F.col("accepted") >= accepted) & (F.col("correct") >= precision * F.col("accepted")))
    fit = fit.join(F.broadcast(known)).where(F.col("correct") >= recall * F.col("known"))  # one row
    best = fit.orderBy(F.desc("correct"), "threshold", "margin").limit(1)
    shares = [F.round(F.col("correct") / F.col(of), 6).alias(name) for of, name in (("accepted", "precision"), ("known", "recall"))]
    return best.select("margin", "threshold", "accepted", "correct", *shares)


def named_like(rows: DataFrame, kind: str, text: str, limit: int) -> DataFrame:
    """(kind, id, name, rank, position): the first `limit` rows (id, name: normalised) whose name is the normalised text
    (rank 0), begins with it (1) or holds it (2), by rank, name and id."""
    found = rows.withColumn("rank", match_rank(F.col("name"), text)).where("rank is not null").orderBy("rank", "name", "id").limit(limit)
    position = F.row_number().over(Window.orderBy("rank", "name", "id"))  # over `limit` rows
    return found.select(F.lit(kind).alias("kind"), "id", "name", "rank", position.alias("position"))


def name_search(text: str, people: DataFrame, identities: DataFrame, sources: DataFrame, occurrences: DataFrame, coverage: DataFrame, wanted: Sequence[str], limit: int) -> DataFrame:
    """One answer of four kinds (PERSON, IDENTITY, SOURCE, OCCURRENCE) with what was searched.

    People, identities and sources are rows (id, name); occurrences (id, identity_id, time_ms) are the newest of the people
    and identities found, which are looked up for them whether or not they are wanted themselves. Every row says the
    query as it was understood, the plan, the kinds asked for and the coverage (total, processed: one row)."""
    query = " ".join(text.split()).casefold()
    kinds = ("PERSON", "IDENTITY", "SOURCE", "OCCURRENCE")
    if not query or limit < 1 or not wanted or any(kind not in kinds for kind in wanted):
        raise ValueError(f"a text, a limit and some of {kinds} are needed")
    found = [named_like(rows, kind, query, limit) for kind, rows in zip(kinds, (people, identities, sources))]
    who = found[0].unionByName(found[1]).select(F.col("id").alias("identity_id"))
    newest = occurrences.join(F.broadcast(who), "identity_id", "left_semi").orderBy(F.desc("time_ms"), F.desc("id")).limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("time_ms"), F.desc("id")))  # over `limit` rows
    found.append(newest.select(F.lit("OCCURRENCE").alias("kind"), "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("rank"), place.alias("position")))
    answer = [rows for kind, rows in zip(kinds, found) if kind in wanted]
    out = answer[0]
    for rows in answer[1:]:
        out = out.unionByName(rows)
    asked = coverage.select(F.lit(query).alias("query"), F.lit("NAME_LOOKUP").alias("plan"), F.lit(",".join(wanted)).alias("kinds"), "total", "processed")
    return out.join(F.broadcast(asked))  # one row


def transition(rows: DataFrame, requests: DataFrame, key: str, states: Sequence[str], to: str) -> DataFrame:
    """Requests (key, revision) against rows (key, state, revision): a request is accepted if the row
    is in one of the states at that revision; accepted rows change state and revision."""
    asked = requests.select(key, F.col("revision").alias("_asked"))
    joined = rows.join(asked, key, "left")
    accepted = F.coalesce(F.col("state").isin(*states) & (F.col("revision") == F.col("_asked")), F.lit(False))
    out = joined.withColumn("accepted", accepted)
    return out.withColumn("state", F.when(F.col("accepted"), to).otherwise(F.col("state"))).withColumn(
        "revision", F.col("revision") + F.col("accepted").cast("int")).drop("_asked")


def coalesced(operations: DataFrame) -> DataFrame:
    """Last operation of each representation in a batch (rep_id, kind, seq)."""
    return latest(operations, ["rep_id"], [F.desc("seq")])


def enqueued(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """(rep_id, kind, seq, action) of a queue's pending rows (rep_id, kind, seq; a kind once a representation) and a batch
    that is appended in the order of `seq`: KEPT, DELETED or INSERTED.

    Each operation of the batch deletes a pending one of the opposite kind and comes in unless its own kind is pending.
    What that leaves follows from the last of each kind: the first operation after the last opposite one comes in,
    unless the batch has no opposite one and its kind was pending. No group of a representation is collected."""
    last = batch.groupBy("rep_id", "kind").agg(F.max("seq").alias("last"))
    ends = last.groupBy("rep_id").agg(F.max_by("kind", "last").alias("to"), F.count("*").alias("kinds"))
    other = last.join(ends, "rep_id").where(F.col("kind") != F.col("to")).select("rep_id", F.col("last").alias("turn"))
    run = batch.join(ends.select("rep_id", F.col("to").alias("kind")), ["rep_id", "kind"]).join(other, "rep_id", "left")
    fresh = run.where(F.col("turn").isNull() | (F.col("seq") > F.col("turn"))).groupBy("rep_id", "kind").agg(F.min("seq").alias("seq"))
    said = queue.join(ends.where("kinds = 1").select("rep_id", F.col("to").alias("kind")), ["rep_id", "kind"], "left_semi").select("rep_id", "kind")
    opposed = last.select("rep_id", F.when(F.col("kind") == "ADD", "REMOVE").otherwise("ADD").alias("kind"), F.lit(True).alias("_gone"))
    old = queue.select("rep_id", "kind", "seq").join(opposed, ["rep_id", "kind"], "left")
    old = old.select("rep_id", "kind", "seq", F.when(F.col("_gone"), "DELETED").otherwise("KEPT").alias("action"))
    new = fresh.join(said, ["rep_id", "kind"], "left_anti").select("rep_id", "kind", "seq", F.lit("INSERTED").alias("action"))
    return old.unionByName(new)


def settled(operations: DataFrame, most: int, base_s: int) -> DataFrame:
    """State after an attempt (ok, attempts): APPLIED, PENDING with backoff, or FAILED at `most`."""
    attempts = F.col("attempts") + 1
    state = F.when(F.col("ok"), "APPLIED").when(attempts >= most, "FAILED").otherwise("PENDING")
    wait = F.when(~F.col("ok") & (attempts < most), (base_s * F.pow(F.lit(2.0), F.col("attempts"))).cast("long"))
    return operations.withColumn("next_state", state).withColumn("wait_s", wait).withColumn("next_attempts", attempts)


def requeued(operations: DataFrame) -> DataFrame:
    """FAILED operations without a PENDING twin of the same representation and kind."""
    twin = operations.where("state = 'PENDING'").select("rep_id", "kind").distinct()
    return operations.where("state = 'FAILED'").join(twin, ["rep_id", "kind"], "left_anti")


def unreferenced(items: DataFrame, key: str, references: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Items that no referencing column holds."""
    every = None
    for frame, column in references:
        one = frame.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        every = one if every is None else every.unionByName(one)
    return items.join(every.distinct(), key, "left_anti")


def first_in_order(rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """(order, a, b) of the rows kept one after another, each unless a kept one before it has its `a`
    or its `b`. `order` is unique; rows with a NULL in `a` or `b` are left out.

    A round keeps the rows that come first in both of their groups and drops what shares a group with
    them; groups are minima with map-side combine, and the tables between rounds are written.
    """
    left = staged(rows.select(order, a, b).dropna(subset=[a, b]), "left")
    kept = left.where(F.lit(False))
    while not left.isEmpty():
        by_a, by_b = (left.groupBy(k).agg(F.min(order).alias(f"_first_{k}")) for k in (a, b))
        first = (F.col(order) == F.col(f"_first_{a}")) & (F.col(order) == F.col(f"_first_{b}"))
        now = staged(left.join(by_a, a).join(by_b, b).where(first).select(order, a, b), "first")
        kept = kept.unionByName(now)
        left = staged(left.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti"), "left")
    return kept


def in_sequence(rows: DataFrame, order: Sequence[str], name: str = "sequence", first: int = 1) -> DataFrame:
    """Rows with gapless numbers in the order of columns that tell them apart.

    In two levels: rows are sorted over ranges and numbered inside each; what earlier ranges hold is added from a row
    a range. No task takes all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    at = staged(at.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "sequence")
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return at.join(F.broadcast(base), "_range").withColumn(name, F.lit(first) + F.col("_base") + F.col("_at")).drop("_range", "_at", "_base")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The change feed between two snapshots: sequence, kind (INSERT, UPDATE, DELETE), key, changed (names of the
    columns that differ, of an UPDATE) and data (the new row; NULL of a DELETE), in the order of the key, without gaps.

    A key names a row of a snapshot; rows without a key are in no feed. Both have the same columns."""
    columns = [c for c in new.columns if c != key]
    sides = [rows.where(F.col(key).isNotNull()).select(key, F.struct(*columns).alias(name)) for rows, name in ((old, "_old"), (new, "data"))]
    differ = F.array(*(F.when(~F.col("_old")[c].eqNullSafe(F.col("data")[c]), F.lit(c)) for c in columns))
    both = sides[0].join(sides[1], key, "full_outer").withColumn("changed", F.filter(differ, lambda c: c.isNotNull()))
    kind = F.when(F.col("_old").isNull(), "INSERT").when(F.col("data").isNull(), "DELETE").when(F.size("changed") > 0, "UPDATE")
    rows = both.withColumn("kind", kind).where("kind is not null")
    return in_sequence(rows.select("kind", key, F.when(F.col("kind") == "UPDATE", F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed"), "data"), [key])


def followed(snapshot: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """A snapshot after a feed of `changes`: the last change of a key wins."""
    last = feed.groupBy(key).agg(F.max_by(F.struct("kind", "data"), "sequence").alias("_c"))
    columns = [c for c in snapshot.columns if c != key]
    kept = snapshot.join(last.select(key), key, "left_anti").select(key, *columns)
    return kept.unionByName(last.where("_c.kind <> 'DELETE'").select(key, *(F.col("_c.data")[c].alias(c) for c in columns)))
