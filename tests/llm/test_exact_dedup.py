"""Operators 1, 4 and 7 against plain versions, at several widths, with hot contents."""

from __future__ import annotations

import random

import pytest

from recallspark.llm import anchors, line_dedup, substring_dedup, suffix_dedup
from tests.llm.corpus import WORD, covered, frame, lines_deleted, rows, sha


@pytest.mark.parametrize("width", [1, 4, 20])
def test_substring_dedup(spark, width):
    docs = [(r[0], WORD.findall((r[1] or "").encode())) for r in rows()]
    gone = covered(docs, width, True)
    want = {did: (len(w), len(gone[did]), sha(b" ".join(x for i, x in enumerate(w) if i not in gone[did]))) for did, w in docs}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark), width).collect()}
    assert got == want


@pytest.mark.parametrize("width", [7, 40, 400])
def test_suffix_dedup(spark, width):
    docs = [(r[0], (r[1] or "").encode()) for r in rows()]
    gone = covered(docs, width, False)
    want = {}
    for did, raw in docs:
        g = gone[did]
        want[did] = len(raw), len(g), sum(i - 1 not in g for i in g), sha(bytes(b for i, b in enumerate(raw) if i not in g))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(frame(spark), width).collect()}
    assert got == want


def test_finer_levels_are_exact(spark, monkeypatch):
    """With hardly any contents allowed to an anchor, every run is cut down to single windows."""
    monkeypatch.setattr(anchors, "MOST", 1)
    test_substring_dedup(spark, 20)
    test_suffix_dedup(spark, 40)


@pytest.mark.parametrize(("noise", "reach", "extend"), [(8, 12, True), (8, 12, False), (1, 1, True), (3, 20, True)])
def test_line_dedup(spark, noise, reach, extend):
    docs = [(r[0], r[1]) for r in sorted(rows()) if r[1] is not None]
    gone = lines_deleted(docs, noise, reach, extend)
    kept = {did: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[did]) for did, t in docs}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup.line_report(frame(spark), noise, reach, extend).collect()}
    want = {did: (len(t.split("\n")), len(gone[did]), sha(kept[did].encode())) for did, t in docs}
    assert got == want | {r[0]: (0, 0, sha(b"")) for r in rows() if r[1] is None}
    assert any(gone.values())
    if extend:
        out = line_dedup.line_dedup(frame(spark), noise, reach)
        assert out.columns == frame(spark).columns
        for r in out.collect():
            assert r["text"] == kept.get(r["doc_id"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["gone"] == "clash"


def test_repeated_runs_of_lines_are_found_whole(spark):
    """Any later run of noise + reach words goes, short last lines and all; without extension they stay."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [[line(25)], [line(9), line(12), line(2)], [line(3) for _ in range(9)] + [line(1)], [line(4), "", line(17), line(3)]]
    data = []
    for k in range(40):
        own = [line(rng.randint(1, 12)) for _ in range(4)]
        own[2:2] = shared[k % 4]
        data.append((k, "\n".join(own), *(None,) * 6))
    left = {extend: {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(frame(spark, data), extend=extend).collect()} for extend in (True, False)}
    full = {k: 0 if k < 4 else sum(x != "" for x in shared[k % 4]) for k in range(40)}
    assert left[True] == full
    assert all(left[False][k] <= full[k] for k in full) and sum(left[False].values()) < sum(full.values())


def test_no_later_copy_of_a_run_keeps_a_line(spark):
    """Sixty corpora of own words, each with a run of 14 short lines in twelve documents, of which an even earlier one
    holds three lines among others; lines of one run that repeats go in all copies but the first."""
    rng, data, runs = random.Random(4), [], {}
    for c in range(60):
        line = lambda n: " ".join(f"w{c}x{rng.randrange(10**6)}" for _ in range(n))  # noqa: B023, E731
        run = [line(rng.randint(1, 6)) for _ in range(14)]
        part = rng.randrange(11)
        docs = [[line(4), *run[part : part + 3], line(4)]]
        docs += [[line(rng.randint(1, 6)) for _ in range(rng.randint(0, 5))] + run + [line(rng.randint(1, 6)) for _ in range(rng.randint(0, 5))] for _ in range(11)]
        for k, lines in enumerate(docs):
            data.append((12 * c + k, "\n".join(lines), *(None,) * 6))
            runs[12 * c + k] = (k, run)
    left = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(frame(spark, data)).collect()}
    for did, (k, run) in runs.items():
        if k > 1:
            assert not set(run) & set(left[did])
        own = [x for x in data[did][1].split("\n") if x not in run]
        assert [x for x in left[did] if x and x not in run] == own


def test_line_dedup_keeps_columns_named_like_its_own(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    names = "doc_id long, x string, c2 string, c1 string, text string, c0 string, kept string, runs string, `a.b` string, fp string"
    docs = spark.createDataFrame([(k, "x", "two", "one", text, "zero", "kept", "runs", "dot", "fp") for k in (1, 2)], names)
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect()) == [(1, "x", "two", "one", text, "zero", "kept", "runs", "dot", "fp"), (2, "x", "two", "one", "", "zero", "kept", "runs", "dot", "fp")]


def test_cut_documents(spark):
    out = suffix_dedup.cut_documents(frame(spark), 40)
    assert out.columns == frame(spark).columns
    gone = covered([(r[0], (r[1] or "").encode()) for r in rows()], 40, False)
    text = {r[0]: r[1] for r in rows()}
    for r in out.collect():
        whole = text[r["doc_id"]]
        left = None if whole is None else bytes(b for i, b in enumerate(whole.encode()) if i not in gone[r["doc_id"]]).decode("utf-8", "ignore")
        assert r["text"] == left and r["spans"] == "clash"


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, line_dedup.line_report, line_dedup.line_dedup, suffix_dedup.cut_documents])
def test_empty_tables_and_repeated_rows(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    twice = [(1, "a b c " * 200, "aa", "s", 0, 0, "", "")] * 2 + [(None, None, None, None, None, None, None, None)] * 2 + [(None, "d e f " * 200, None, None, None, None, None, None)]
    out = operator(frame(spark, twice)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "None", "None", "None"]
    assert len({r for r in out if r["doc_id"] == 1}) == 1
