"""Operator 1 on documents of more than one block."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from recallspark.llm import anchors, substring_dedup, suffix_dedup
from recallspark.llm import text as tx
from tests.llm.corpus import WORD


def plain(words: list[bytes], width: int) -> list[tuple]:
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


@pytest.mark.parametrize("text", [
    " ".join("xyzabcdefghijk"[k % 14] * 20 for k in range(40)),  # few words a block, none before the first
    "  " + " ".join(c * 17 for c in "abcdefghijklmnopq"),
    "one two " + "w" * 300 + " three four five six " + "v" * 150 + " seven eight nine ten",  # words longer than two blocks
    "a b c d e f g h i j " * 40,
    " " * 200 + "a b c d e f" + " " * 200 + "g h i j" + " " * 130,
])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_every_window_lies_in_a_part(monkeypatch, text, width):
    monkeypatch.setattr(tx, "BLOCK", 64)
    data = np.frombuffer(text.encode(), np.uint8)
    words = WORD.findall(text.encode())
    whole = tx.word_hashes(data, *tx.word_bounds(data, np.array([0]))).tolist()
    assert len(whole) == len(words)
    seen = set()
    for sym, _, _, base in anchors.units(substring_dedup.word_windows(width), data, np.array([0, len(data)])):
        assert sym.tolist() == whole[base : base + len(sym)]
        new = set(range(base, base + len(sym) - width + 1))
        assert not new & seen
        seen |= new
    assert seen == set(range(len(plain(words, width))))


def test_a_task_holds_little_beside_its_text(monkeypatch):
    monkeypatch.setattr(tx, "_powers", {})
    texts = pa.array([f"{k} " + "some words of a text " * 200 for k in range(1200)])
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["did", "tie", "text"])
    tracemalloc.start()
    found = sum(x.num_rows for x in anchors._runs_of(suffix_dedup.byte_windows(240))([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and most < 150 << 20
