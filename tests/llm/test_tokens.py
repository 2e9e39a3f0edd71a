"""Operators 6 and 10: every token in exactly one piece, exact round trips, best paths, chunks."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from recallspark.llm import packing, pieces
from tests.llm.corpus import frame, rows

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(800, "<|endoftext|> in a text"), (801, "É É ß İ ﬁ \x01 \x00 á"), (802, "tab\tand\r\nline  two   spaces "), (803, "日本語 🙂👩‍👩‍👧 ﷽"), (804, "▁own ▁▁ mark"), (805, "end. end, end., A.B")]


def data():
    return [(r[0], r[1]) for r in rows()] + ODD


def table(spark, found):
    return frame(spark, [(*x, *(None,) * 6) for x in found])


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = {d: np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in data()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(table(spark, data()), WORDS).collect():
        docs[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(part) > 0
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for found, totals in ((docs, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for key, parts in found.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at
                at += n
            assert at == totals[key] if totals else at <= 4096
    assert set(docs) == set(ids)
    full = sum(4096 if (n := sum(x[1] for x in s)) & (n - 1) else n for s in sequences.values())
    assert full <= 1.01 * sum(map(len, ids.values()))


def test_tiers_and_step_groups(spark):
    """A window of a tier holds whole documents of that tier or shorter ones (longer only as cut parts), and
    all step groups of a size but the last cost the same, over all tasks."""
    found = packing.pack(table(spark, data() * 12), WORDS).collect()
    groups, windows = defaultdict(int), defaultdict(list)
    for r in found:
        groups[r["tier"], r["step_group"]] += r["length"]
        windows[r["sequence_id"]].append(r)
    assert len({r["sequence_id"] >> 40 for r in found}) > 1
    for size in {t for t, _ in groups}:
        mine = [n for (t, _), n in sorted(groups.items()) if t == size]
        assert all(n == packing.STEP for n in mine[:-1]) and mine[-1] <= packing.STEP
        assert sorted(g for t, g in groups if t == size) == list(range(len(mine)))
    for rows_ in windows.values():
        size = rows_[0]["tier"]
        assert sum(r["length"] for r in rows_) == size and all(r["tier"] == size for r in rows_)
        assert all(r["length"] <= size for r in rows_)


def test_packing_edges(spark):
    assert packing.pack(table(spark, []), WORDS).count() == 0
    out = packing.pack(table(spark, [(None, None), (5, ""), (5, "")]), WORDS).collect()
    assert sorted((str(r["doc_id"]), r["length"], r["doc_tokens"]) for r in out) == [("5", 1, 1), ("5", 1, 1), ("None", 1, 1)]


def test_best_paths_of_units():
    model, rng = pieces.Pieces(PIECES), random.Random(4)
    parts = ["a", "the", "ing", pieces.SPACE, "é", "日", pieces.OWN_SPACE, "%", "\n", "Q"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        best, back = model.paths(text, 0, len(text))
        assert model.best_path(text) == (best[-1], np.array(model.ids_of(text, 0, len(text), back), "<u4").tobytes())


def best_value(model, text: str) -> int:
    """Largest total of any way to cut the text, by position from the right."""
    best = [0] * (len(text) + 1)
    for p in range(len(text) - 1, -1, -1):
        ways = [model.value.get(text[p], model.unknown) + best[p + 1]]
        ways += [model.value[text[p:q]] + best[q] for q in range(p + 2, min(len(text), p + 16) + 1) if text[p:q] in model.value]
        best[p] = max(ways)
    return best[0]


@pytest.mark.parametrize("chunk", [1 << 14, 700, 37])
def test_chunks_give_the_same_best_paths(spark, chunk):
    """Parallel scans over many chunks and blocks: same value as one path, ids that decode exactly."""
    model = pieces.Pieces(PIECES)
    found = pieces.encode(table(spark, data()), PIECES, chunk)
    back = {r["did"]: r["text"] for r in pieces.decode(found, PIECES).collect()}
    value = {r["did"]: (r["score"], r["n_chars"]) for r in found.select("did", "score", "n_chars").collect()}
    for did, text in data():
        text = text or ""
        assert back[did] == text and value[did] == (best_value(model, pieces.normalised(text)), len(text))


def test_about_as_many_pieces_as_the_library():
    import sentencepiece

    model, library = pieces.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = ["the house is big, and the people of the old town were happy to see it.", "La maison est grande et les gens sont contents.", "Das Haus ist alt, und die Leute sind froh."]
    ours, theirs = (sum(n) for n in ([len(model.encode(x)[1]) // 4 for x in text], [len(library.encode(x)) for x in text]))
    assert ours <= 1.03 * theirs
    assert [library.id_to_piece(i) for i in np.frombuffer(model.encode("the house is big")[1], "<u4").tolist()] == ["▁the", "▁house", "▁is", "▁big"]


def test_digest_edges(spark):
    assert pieces.digest(pieces.encode(table(spark, []), PIECES), PIECES).count() == 0
    out = pieces.digest(pieces.encode(table(spark, [(None, None), (5, "x"), (5, "x")]), PIECES), PIECES).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in out) == [("5", 1), ("5", 1), ("None", 0)]


def test_every_character_comes_back(spark):
    """U+2581, U+FFFF and their like are characters of their own, in short texts and across chunks."""
    odd = "a\u2581b\uffff \u2581\uffff\ufffe  \u00a0\u2581 x\U0010ffff"
    texts = [odd, "\uffff", "\u2581", odd * 40, " \u2581" * 300]
    docs = frame(spark, [(k, x, *(None,) * 6) for k, x in enumerate(texts)])
    for chunk in (16_384, 33):
        found = pieces.encode(docs, PIECES, chunk)
        assert {r["did"]: r["text"] for r in pieces.decode(found, PIECES).collect()} == dict(enumerate(texts))
        assert {r["did"]: r["n_chars"] for r in found.collect()} == {k: len(x) for k, x in enumerate(texts)}
