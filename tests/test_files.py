"""Readers and sinks of files, and chunks of a stream over a restart."""

from __future__ import annotations

import hashlib
import json

import pytest

from recallspark.sources import files
from recallspark.streaming import chunks


def test_import_and_folders(spark, tmp_path):
    for person, name, body in (("ann", "a.jpg", b"one"), ("ann", "b.jpg", b"two"), ("bob", "a.jpg", b"one"), ("bob", "c.txt", b"no")):
        (tmp_path / person).mkdir(exist_ok=True)
        (tmp_path / person / name).write_bytes(body)
    found = files.listing(spark, str(tmp_path), "*.jpg")
    people = sorted((r["person"], r["path"].rsplit("/", 1)[1]) for r in files.labelled_folders(found).collect())
    assert people == [("ann", "a.jpg"), ("ann", "b.jpg"), ("bob", "a.jpg")]
    known = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(),)], "digest string")
    sources, artifacts = files.imported(found, known)
    assert sources.count() == 3 and [r["digest"] for r in artifacts.collect()] == [hashlib.sha256(b"one").hexdigest()]


def test_labelled_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a.jpg 12\n\nb.jpg  7 \nbroken\n")
    assert sorted(tuple(r) for r in files.labelled_list(spark, str(tmp_path / "ids.txt")).collect()) == [("a.jpg", "12"), ("b.jpg", "7")]


def test_append_log(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"key": 1, "word": "a"}\n{"key": oops}\n{"key": 2, "word": "b"}\n{"key": 3, "wo')
    good, bad = files.append_log(spark, str(log), "key: bigint, word: string")
    assert [(r["key"], r["word"]) for r in good.orderBy("at").collect()] == [(1, "a"), (2, "b")]
    assert sorted((r["value"], r["torn"]) for r in bad.collect()) == [('{"key": 3, "wo', True), ('{"key": oops}', False)]
    log.write_text('{"key": 1, "word": "a"}\n')
    good, bad = files.append_log(spark, str(log), "key: bigint, word: string")
    assert good.count() == 1 and bad.count() == 0


def test_report(spark, tmp_path):
    files.report(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "part string, n int"), str(tmp_path / "out"), "part")
    lines = [json.loads(x) for f in (tmp_path / "out" / "part=x").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(r["n"] for r in lines) == [1, 2]


def test_chunks_over_a_restart(spark, tmp_path):
    for run in range(2):  # the second run resumes where the first stopped
        for k in range(2):
            spark.range(10 * (2 * run + k), 10 * (2 * run + k) + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        chunks.record(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))


def test_a_checked_log_refuses_damage(spark, tmp_path):
    """A torn last line is left out; a broken line before it, or a version nobody knows, is refused."""
    whole = '{"version": 1, "id": 1}\n{"version": 2, "id": 2}\n'
    for name, text in (("torn", whole + '{"version": 1, "i'), ("broken", '{"versi\n' + whole), ("strange", whole + '{"version": 9, "id": 3}\n')):
        (tmp_path / name).write_text(text)
    read = lambda name: files.checked_log(spark, str(tmp_path / name), "version int, id int", "version", [1, 2])
    assert sorted(r["id"] for r in read("torn").collect()) == [1, 2]
    for name in ("broken", "strange"):
        with pytest.raises(ValueError, match=name):
            read(name)
