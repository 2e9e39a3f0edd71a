"""Rows without a doc_id, and different texts under one doc_id: each text is a document of its own."""

from __future__ import annotations

from collections import Counter

import xxhash

from recallspark.llm import anchors, line_dedup, similar, simhash, substring_dedup, suffix_dedup
from recallspark.llm.tables import row_keyed
from recallspark.llm.text import NO_ID
from tests.llm.corpus import WORD, covered, frame, lines_deleted, rows, sha
from tests.llm.test_near_dedup import plain_classes, plain_fingerprint
from tests.llm.test_similar import plain_groups


def shared() -> list[tuple]:
    """A third of the rows without a doc_id, a third under two ids."""
    return [({0: None, 1: r[0] % 2}.get(r[0] % 3, r[0]), *r[1:]) for r in rows()]


def documents() -> list[tuple[tuple[int, int], str]]:
    """((id, signed hash of the text), text) of the distinct rows with a text, in order."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted({((NO_ID if r[0] is None else r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), r[1]) for r in shared() if r[1] is not None})


def each(result: dict) -> Counter:
    """What `result` says of (doc_id, text), once for every row."""
    return Counter((r[0], *result[r[0], r[1]]) for r in shared() if r[1] is not None)


def found(out, *names) -> Counter:
    return Counter(tuple(r[c] for c in ("doc_id", *names)) for r in out.collect())


def test_substring_dedup(spark):
    docs = documents()
    split = [WORD.findall(x.encode()) for _, x in docs]
    gone = covered(list(enumerate(split)), 20, True)
    say = {(None if k[0] == NO_ID else k[0], x): (len(w), len(gone[i]), sha(b" ".join(y for j, y in enumerate(w) if j not in gone[i]))) for i, ((k, x), w) in enumerate(zip(docs, split))}
    got = found(substring_dedup.substring_dedup(frame(spark, [r for r in shared() if r[1] is not None])), "n_words", "n_removed", "kept_sha256")
    assert got == each(say)


def test_suffix_dedup(spark):
    data = [r for r in shared() if r[1] is not None]
    raw = [r[1].encode() for r in data]
    gone = covered(list(enumerate(raw)), 40, False)
    left = [bytes(b for j, b in enumerate(x) if j not in gone[i]) for i, x in enumerate(raw)]
    assert found(suffix_dedup.suffix_dedup(frame(spark, data), 40), "n_bytes", "n_removed", "kept_sha256") == Counter((r[0], len(x), len(gone[i]), sha(left[i])) for i, (r, x) in enumerate(zip(data, raw)))
    assert found(suffix_dedup.cut_documents(frame(spark, data), 40), "text") == Counter((r[0], x.decode("utf-8", "ignore")) for r, x in zip(data, left))


def test_line_dedup(spark):
    docs = documents()
    gone = lines_deleted([(i, x) for i, (_, x) in enumerate(docs)], 8, 12)
    kept = {(None if k[0] == NO_ID else k[0], x): ("\n".join(y for j, y in enumerate(x.split("\n")) if j not in gone[i]),) for i, (k, x) in enumerate(docs)}
    assert found(line_dedup.line_dedup(frame(spark, [r for r in shared() if r[1] is not None])), "text") == each(kept)


def test_one_of_each(spark):
    docs = documents()
    classes = plain_classes({i: plain_fingerprint(x) for i, (_, x) in enumerate(docs)}, 4)
    want = {(None if docs[i][0][0] == NO_ID else docs[i][0][0], docs[i][1]) for i in set(classes.values())}
    assert found(simhash.one_of_each(frame(spark, [r for r in shared() if r[1] is not None])), "text") == Counter(want)


def test_unlike_rows_without_an_id_all_stay(spark):
    text = {x for _, x in documents() if len(x.split()) > 100}
    data = [(None, x, None, None, None, None, None, None) for x in sorted(text)]
    assert simhash.one_of_each(frame(spark, data)).count() == len(set(plain_classes({i: plain_fingerprint(r[1]) for i, r in enumerate(data)}, 4).values())) > 5


def test_similar_one_of_each(spark):
    docs = documents()
    classes = plain_groups([x for _, x in docs])
    want = {(None if docs[i][0][0] == NO_ID else docs[i][0][0], docs[i][1]) for i in set(classes)}
    assert found(similar.one_of_each(frame(spark, [r for r in shared() if r[1] is not None])), "text") == Counter(want)


def test_repeated_rows_are_one_group(spark):
    """3,000 equal rows without an id: their runs and spans are those of one text, and every row is cut alike."""
    text = " ".join(f"w{k}" for k in range(300))
    data = [(None, text, *(None,) * 6)] * 3000 + [(1, "own start " + text, *(None,) * 6)]
    docs = frame(spark, data)
    for windows in (substring_dedup.word_windows(20), suffix_dedup.byte_windows(400)):
        most = anchors.repeated_spans(row_keyed(docs), windows).groupBy("did", "tie").count().agg({"count": "max"}).first()[0]
        assert most < 4 * len(text)
    out = {(r["doc_id"], r["n_words"], r["n_removed"]): r["count"] for r in substring_dedup.substring_dedup(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert out == {(1, 302, 0): 1, (None, 300, 300): 3000}
    assert suffix_dedup.suffix_dedup(docs).where("doc_id is null and n_removed <> n_bytes").isEmpty()
    alone = substring_dedup.substring_dedup(docs.where("doc_id is null")).agg({"n_removed": "max"}).first()[0]
    assert alone == 0
    assert suffix_dedup.suffix_dedup(docs.where("doc_id is null")).agg({"n_removed": "min"}).first()[0] == len(text)
