"""Filter interaction audit: what five filters remove alone, together and in every order.

A relational pipeline of words, in DataFrame functions only:

1. *Texts.* Documents are reduced to distinct texts, named by their SHA-256, before anything is exploded
   (map-side combine: copies, however many, are one row a task), with the smallest doc_id of each.
2. *Words.* The words of each text are exploded and counted by (text, word), then by text: totals and
   distincts. Both groupings reuse the partitioning by text, so words are never shuffled.
3. *Flags.* The counts are outer-joined with the other flags of the text (no word, no row).
4. *Documents* are reduced to (text, part, labels) with their number, and that of the smallest doc_id,
   before they are joined to the flags: a text that a third of all documents hold is a few rows there.
5. *Masks.* A document fails a set of filters, one of 32. Documents are summed by part and mask, and
   then into 32 conditional-count columns a part (each for all, good and toxic documents).
6. *Orders.* All 120 orders and their steps are computed from these columns alone.

Defined results: a NULL text is empty; a NULL doc_id sorts last, so it is never the smaller one of two;
repeated rows count each and are no copies of each other (their doc_id is not smaller); a NULL lang and
an empty one are one part; a doc_id with several labels is good (toxic) if one of them says so; an
empty table has no part, hence no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.text import NO_ID

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3  # words; per cent of words; per cent of code points
KINDS = ("all", "good", "toxic")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("name"), text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))


def text_flags(docs: DataFrame) -> DataFrame:
    """(name, least, a, b, c, d): each distinct text, the smallest doc_id that holds it, and what it fails."""
    named = _named(docs)
    words = named.groupBy("name").agg(F.min("text").alias("text")).select("name", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy("name", "word").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    # the other flags leave the text where it is read, and a regular expression would visit every character for the capitals
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = named.select("name", "did", (100 * capitals > MAX_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"))
    others = flags.groupBy("name").agg(F.min("did").alias("least"), F.max("c").alias("c"), F.max("d").alias("d"))
    n, kinds = F.coalesce("n", F.lit(0)), F.coalesce("kinds", F.lit(0))
    return others.join(counts, "name", "left").select("name", "least", (n < MIN_WORDS).alias("a"), (100 * kinds < MIN_DISTINCT * n).alias("b"), "c", "d")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, all, good, toxic): documents of a part that fail exactly the filters in the mask (bit i: filter i)."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # The rows of one doc_id, text and part are one from here on, which is what keeps rows without a doc_id from being a hot key.
    rows = _named(docs).groupBy("did", "name", "part").agg(F.count("*").alias("n")).join(marks, "did", "left")
    rows = rows.select("did", "name", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    held = rows.groupBy("name", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("did", "n")).alias("low"))
    found = held.join(text_flags(docs), "name")
    first = F.when(F.col("low.did") == F.col("least"), F.col("low.n")).otherwise(F.lit(0))
    plain = sum((F.when(F.col(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate("abcd")), F.lit(0))
    each = F.explode(F.array(
        F.struct(plain.alias("mask"), first.alias("n")), F.struct((plain + 16).alias("mask"), (F.col("n") - first).alias("n")),
    ))
    found = found.select("part", "good", "toxic", each.alias("m")).select("part", "m.mask", F.col("m.n").alias("n"), "good", "toxic")
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    ).where("all > 0")


def _over(kind: str, keep) -> Column:
    """Sum of the columns of a kind whose mask fulfils a condition."""
    return F.aggregate(F.transform(kind, lambda n, m: F.when(keep(m), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; and `filter`, the letter of the step."""
    masks = mask_counts(docs, labels)
    columns = [F.sum(F.when(F.col("mask") == m, F.col(k)).otherwise(0)).alias(f"{k}_{m}") for k in KINDS for m in range(32)]
    wide = masks.groupBy("part").agg(*columns)
    parts = wide.select("part", *(F.array(*(F.col(f"{k}_{m}") for m in range(32))).alias(k) for k in KINDS))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    steps = parts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = lambda of: sum((F.when(of(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("*", letter.alias("filter"), bit(lambda x: letter == x).alias("own"), bit(lambda x: F.instr("filter_order", x) < F.col("step")).alias("before"))
    own, before = F.col("own"), F.col("before")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    shares = F.array(*(F.lit(120 // k).cast("long") for k in range(1, 6)))
    # a document that fails k filters goes at its own one in the orders that have that one first of the k: 120 / k
    weighed = F.aggregate(
        F.transform("all", lambda n, m: F.when(m.bitwiseAND(own) != 0, n * F.get(shares, F.bit_count(m) - 1)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, n: a + n,
    )
    return steps.select(
        "part", "filter_order", "step", "filter",
        _over("all", lambda m: m.bitwiseAND(own + before) == 0).alias("kept"),
        _over("all", here).alias("removed"),
        _over("all", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _over("all", lambda m: m == own).alias("unique_fails"),
        _over("good", here).alias("good_lost"),
        _over("toxic", here).alias("toxic_lost"),
        weighed.alias("shapley"),
    )
