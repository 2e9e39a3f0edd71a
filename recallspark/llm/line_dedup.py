"""Line dedup by winnowing, in DataFrame functions only.

Lines are the parts of a text between \\n; those without a word (a run of characters other than space
and 0x09-0x0D) are skipped over and never deleted. All below counts lines with words.

1. *Select.* The unit of a line is the shortest run of lines from it on that holds `noise` words. A
   window is the units that start in `reach` words from a line on; its smallest unit hash (leftmost on
   a tie) is a fingerprint. Runs of noise + reach words hold a whole window, so they have a
   fingerprint in common, at one offset, wherever they repeat; a longer single line is a window by
   itself. Most windows share their fingerprint with their neighbours.
2. *Join positions.* Fingerprints that are selected once are dropped by an equi-join with their counts. A
   place carries the lines of `reach` words before it and of noise + reach words after it: no shared run
   of that length reaches farther beyond the first, the last and between two of its fingerprints.
3. *Extend both ways.* Every run of lines that ends or begins with the unit, within what the place carries,
   is a key; its first place (smallest doc_id, then hash of the text, then line) is a minimum with
   map-side combine, so a run that a third of all documents share is one row a task. A run with an
   earlier place repeats, whichever document that is in, so the longest match with any earlier place is
   found without comparing places to each other. Joins back are equi-joins on written rows, which AQE
   splits on a hot key.
4. *Delete* the lines of the runs so found at the later place; the first place keeps them. Runs are
   judged on the input. A run of noise + reach words or more that repeats goes whole.

Hashes are 60 bits of MD5. Defined results: a NULL text stays NULL and has no lines; a NULL doc_id sorts last;
different texts of one doc_id or without any are documents of their own; rows that share doc_id and text get the
same deletions; a text of fewer than `noise` words is kept; an empty table gives an empty result; other
columns of the input are kept by `line_dedup`, whatever their names, and ignored by `line_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.tables import text_key
from recallspark.llm.text import NO_ID
from recallspark.sources.staging import staged

NOISE, REACH = 8, 12

WORD = r"[^\x20\x09-\x0D]+"


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _number(text: Column) -> Column:
    """60 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _many(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))


def _enough(sizes: Column, words: int) -> Column:
    """How many of the first elements add up to `words`; NULL if all of them do not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    more = lambda a, x: F.when(a["sum"] >= words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum")))
    return F.aggregate(sizes, start, more, lambda a: F.when(a["sum"] >= words, a["n"]))


def fingerprints(docs: DataFrame, noise: int = NOISE, reach: int = REACH) -> DataFrame:
    """(did, tie, fp, pos, unit, left, right): each selected unit, its first line and number of lines, and
    the hashes of the lines before it (nearest first) and from it on, as far as a place carries them."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(_many(x).alias("w"), _number(x).alias("h"))), lambda x: x["w"] > 0)
    own = docs.where("text is not null").select(_did().alias("did"), text_key(), lines.alias("l"))
    # Arrays that a lambda looks into are used twice or more and nothing filters on them (hence the outer
    # explode), or Catalyst would move what makes them into the lambda.
    own = own.select("did", "tie", F.transform("l", lambda x: x["h"]).alias("h"), F.transform("l", lambda x: x["w"]).alias("w"))
    each = F.when(F.size("h") > 0, F.sequence(F.lit(1), F.size("h")))
    unit = F.transform(each, lambda i: _enough(F.slice("w", i, noise), noise))
    own = own.select("did", "tie", "h", "w", unit.alias("k"))
    hashed = F.transform(each, lambda i: F.when(F.get("k", i - 1).isNotNull(), _number(F.array_join(F.transform(F.slice("h", i, F.coalesce(F.get("k", i - 1), F.lit(0))), lambda x: x.cast("string")), ","))))
    own = own.select("did", "tie", "h", "w", "k", hashed.alias("u"))

    def least(i: Column) -> Column:
        some = F.slice("u", i, F.coalesce(_enough(F.slice("w", i, reach), reach), F.lit(reach)))
        return i + F.array_position(some, F.array_min(some)).cast("int") - 1

    at = F.array_distinct(F.filter(F.transform(each, least), lambda p: p.isNotNull()))
    own = own.select("did", "tie", "h", "w", "k", "u", at.alias("at"))

    def place(p: Column) -> Column:
        low = F.greatest(F.lit(1), p - reach)
        before = F.coalesce(_enough(F.reverse(F.slice("w", low, p - low)), reach), p - low)
        after = F.coalesce(_enough(F.slice("w", p + 1, noise + reach), noise + reach), F.lit(noise + reach))
        return F.struct(
            F.get("u", p - 1).alias("fp"), (p - 1).alias("pos"), F.get("k", p - 1).alias("unit"),
            F.reverse(F.slice("h", p - before, before)).alias("left"), F.slice("h", p, after + 1).alias("right"),
        )

    return own.select("did", "tie", F.explode_outer(F.transform("at", place)).alias("p")).where("p is not null").select("did", "tie", "p.*")


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: x.cast("string")), ",")


def repeated_runs(docs: DataFrame, noise: int = NOISE, reach: int = REACH, extend: bool = True) -> DataFrame:
    """(did, tie, a, b): runs of lines [a, b) that repeat an earlier place. Without `extend`, only the
    units of the fingerprints themselves."""
    places = staged(fingerprints(docs, noise, reach), "places")
    many = places.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    places = places.join(many, "fp")
    ahead, back = F.sequence(F.col("unit"), F.size("right")), F.sequence(F.lit(1), F.size("left"))
    if not extend:
        ahead, back = F.array("unit"), F.array().cast("array<int>")
    run = lambda lines, a, b: F.struct(_number(lines).alias("run"), a.alias("a"), b.alias("b"))
    pos = F.col("pos")
    ahead = F.transform(ahead, lambda n: run(_joined(F.slice("right", 1, n)), pos, pos + n))
    back = F.transform(F.when(F.size("left") > 0, back), lambda n: run(F.concat_ws("|", _joined(F.slice("left", 1, n)), _joined(F.slice("right", 1, F.col("unit")))), pos - n, pos + F.col("unit")))
    each = F.explode(F.concat(ahead, F.coalesce(back, F.array().cast("array<struct<run:bigint,a:int,b:int>>"))))
    runs = staged(places.select("did", "tie", "pos", each.alias("r")).select("did", "tie", "pos", "r.*"), "runs")
    first = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("did", "tie", "pos")).alias("f")).where("n > 1").select("run", "f")
    return runs.join(first, "run").where("did <> f.did or tie <> f.tie or pos <> f.pos").select("did", "tie", "a", "b")


def _cut(docs: DataFrame, noise: int, reach: int, extend: bool = True) -> DataFrame:
    runs = repeated_runs(docs, noise, reach, extend).groupBy("did", "tie").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    found = docs.withColumn("did", _did()).withColumn("tie", text_key()).join(runs, ["did", "tie"], "left")
    parts = F.split("text", "\n")
    worded = F.filter(F.transform(parts, lambda x, i: F.when(_many(x) > 0, i)), lambda i: i.isNotNull())
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"] - 1))))
    found = found.select(*docs.columns, "runs", parts.alias("parts"), F.when(F.col("runs").isNotNull(), worded).alias("worded"), gone.alias("gone"))
    numbers = F.transform("gone", lambda g: F.get("worded", g))
    found = found.select(*docs.columns, "parts", numbers.alias("gone"), F.size("worded").alias("n_worded"), F.size("parts").alias("n"))
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    lines = F.coalesce(F.when(F.size("parts") > 0, F.col("n")), F.lit(0))
    return found.select(*docs.columns, kept.alias("kept"), lines.alias("n_lines"), F.when(F.col("n_worded") > 0, F.size("gone")).otherwise(0).alias("n_removed"))


def line_dedup(docs: DataFrame, noise: int = NOISE, reach: int = REACH) -> DataFrame:
    """The documents with later repeated runs deleted; n_chars, if there, is counted again."""
    own = [F.col(f"`{c}`").alias({"doc_id": "doc_id", "text": "text"}.get(c, f"c{i}")) for i, c in enumerate(docs.columns)]
    out = _cut(docs.select(*own), noise, reach)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)}
    back |= {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")}
    if "n_chars" in back:
        back["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*back.values())


def line_report(docs: DataFrame, noise: int = NOISE, reach: int = REACH, extend: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left (NULL: of the empty text)."""
    out = _cut(docs.select("doc_id", "text"), noise, reach, extend)
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.col("kept"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
