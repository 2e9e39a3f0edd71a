"""Folding and decomposition of every character against Python's own."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from recallspark.functions import names


def test_every_character_is_folded_and_decomposed(spark):
    points = [i for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    texts = ["".join(map(chr, points[a : a + 40])) for a in range(0, len(points), 40)]
    texts += [f"x{c}y z" for c in "ßŉǰΐẞﬁﬃᾳİſςΣꭰᏸ½①㎏Ａ９éø日ⅷ"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").repartition(8)
    got = {r["k"]: r for r in frame.select("k", names.case_folded(F.col("x")).alias("fold"), names.plain_ascii(F.col("x")).alias("plain"), names.slug(F.col("x")).alias("slug"), names.normalised(F.col("x")).alias("normal")).collect()}
    for k, x in enumerate(texts):
        plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
        assert got[k]["fold"] == x.casefold()
        assert got[k]["plain"] == plain
        assert got[k]["slug"] == re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_")
        assert got[k]["normal"] == " ".join(x.split()).casefold()


def test_empty_and_missing_names(spark):
    row = spark.createDataFrame([("",), (None,), ("  \t ",)], "x string").select(names.normalised(F.col("x")).alias("n"), names.slug(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in row] == [("", ""), (None, None), ("", "")]
