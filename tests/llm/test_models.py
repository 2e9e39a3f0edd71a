"""Operators 2, 8 and 9: held-out accuracy, plain statistics, and the edges."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import language_id, quality_rules, queries, toxicity
from tests.llm.corpus import frame, rows

SF = "/root/testdata/sf0.01"


def held(doc_id, modulus: int, rest: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def test_suffix_automaton_parses_longest_matches():
    texts = {"aa": "abracadabra abracad", "bb": "the cat sat on the mat"}
    model = language_id.learn([(k, [x], [x]) for k, x in texts.items()])

    def phrases(text: str, known: str) -> int:
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in known:
                k += 1
            n, i = n + 1, i + k
        return n

    for text in ("abracat on", "the mat", "dabra sat cad", "zzz abra"):
        found = model.rates([text])[0] * len(text)
        assert found.round().tolist() == [phrases(text, x) for x in texts.values()]


def test_language_held_out(spark):
    out = queries.op2_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(out) == len(lang)
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in out) and all(0 <= r["score"] <= 1 for r in out)
    known = [r for r in test if lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in known]) >= 0.97


def test_language_edges(spark):
    model = language_id.learn([("aa", ["hello there world"], []), ("bb", ["bonjour le monde"], [])])
    data = [(1, None), (2, ""), (3, "12 34 %%"), (4, "hello world"), (4, "hello world"), (None, "le monde")]
    out = language_id.identify(frame(spark, [(i, x) + (None,) * 6 for i, x in data]), model)
    found = Counter((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert found == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "aa"): 2, (None, "bb"): 1})
    empty = frame(spark, [])
    assert language_id.identify(empty, language_id.train(empty, language_id.usable_rows())).count() == 0
    assert language_id.learn([]).predict(["text"])[0][0] == "und"
    foreign = [(9, "日本" * 60), (10, "qzx kvj wqp zzx " * 20)]
    kept = language_id.keep_identified(frame(spark, [(i, x) + (None,) * 6 for i, x in data + foreign]), model)
    assert kept.columns == empty.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "None"]


def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in queries.op8_toxicity(spark, SF).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()
    test = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in marks if r["doc_id"] in out and held(r["doc_id"], 3, 1)]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    toxic, clean = [p for p, t in test if t], [p for p, t in test if not t]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.05


def test_swapped_terms_hardly_move_a_score():
    """The groups are named mostly in toxic sentences; the penalty takes that out of the score."""
    bag = lambda x: {f for w in toxicity.words_of(x) for f in toxicity.features_of(w)}
    bags = [bag(f"muslim awful {k}") for k in range(30)] + [bag(f"awful thing {k}") for k in range(10)]
    bags += [bag(f"christian nice {k}") for k in range(30)] + [bag(f"nice thing {k}") for k in range(10)]
    names = sorted({f for b in bags for f in b} | {f for t in toxicity.IDENTITY["religion"] for f in toxicity.features_of(t)})
    toxic = [1] * 40 + [0] * 40
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(bags, toxic, names, penalty=penalty)
        gap[penalty] = abs(model.logit(toxicity.words_of("muslim nice day"), {}) - model.logit(toxicity.words_of("christian nice day"), {}))
    assert gap[toxicity.PENALTY] < 0.2 * gap[0.0]


def plain_score(model, text: str | None) -> float:
    words = set(re.findall(r"\w+", (text or "").lower()))
    seen = words | {f"^{w[:k]}" for w in words for k in (4, 5, 6) if len(w) >= k}
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in sorted(seen)))))


def test_penalty_keeps_mentions_neutral(spark):
    """Trained on the given labels: naming one group or another in a clean held-out text hardly moves the
    score, without the penalty it does; scores equal a plain sum of weights, also on very long texts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    usable, found = ~language_id.held_out(3, 1), {}
    for penalty in (0.0, toxicity.PENALTY):
        found[penalty] = toxicity.train(docs, labels, usable, penalty)
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(150).collect()]
    assert toxicity.swing(found[toxicity.PENALTY], clean) < 0.05 < 1 < toxicity.swing(found[0.0], clean)
    model = found[toxicity.PENALTY]
    texts = [*clean[:50], None, "", " ".join(clean) * 5, clean[0], clean[0]]
    got = toxicity.score(frame(spark, [(i, x) + (None,) * 6 for i, x in enumerate(texts)]), model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], [plain_score(model, x) for x in texts])
    assert got[-1]["score"] == got[-2]["score"]


def test_toxicity_edges(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, language_id.held_out(3, 1))
    assert toxicity.score(docs, model).count() == 0
    out = toxicity.score(frame(spark, [(None, None) + (None,) * 6, (1, "") + (None,) * 6, (1, "") + (None,) * 6]), model).collect()
    assert len(out) == 3 and len({r["score"] for r in out}) == 1 and not any(r["predicted"] for r in out)


def plain_statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    repeat = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(repeat)


def test_quality_statistics(spark):
    forest = quality_rules.Forest([], 1)
    odd = [(900, "a b\x0bc\x0cd\x85e f\x1cg " * 30), (901, "| # |\n| # |\n\x0b\n\x0b\n" * 40), (902, "日本 語 " * 60)]
    data = [(r[0], r[1]) for r in rows()] + odd
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, [(*x, *(None,) * 6) for x in data]), forest).collect()}
    for did, text in data:
        want, r = plain_statistics(text), got[did]
        assert tuple(r[k] for k in quality_rules.STATS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    forest = quality_rules.fit(x)
    usual, far = forest.score(x), forest.score(np.full((1, 3), 9.0))
    assert far[0] > usual.max() and np.median(usual) < 0.5


def test_quality_keeps_good_documents(spark):
    out = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SF).collect()}
    marks = [r for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect() if r["doc_id"] in out and not out[r["doc_id"]]["base_failed"]]
    assert np.mean([out[r["doc_id"]]["kept"] for r in marks if r["quality"] == 1]) >= 0.98


def test_quality_verdict_on_held_out_labels(spark):
    """Calibrated on the labels of even ids, judged on those of odd ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_rules.train(docs, labels.where("doc_id % 2 = 0"))
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, forest).collect()}
    marks = [r for r in labels.where("doc_id % 2 = 1 and quality is not null").collect() if not out[r["doc_id"]]["base_failed"]]
    assert np.mean([out[r["doc_id"]]["kept"] for r in marks if r["quality"] == 1]) >= 0.95
    same = quality_rules.judge(frame(spark, [(k, "ties and " * 40_000) + (None,) * 6 for k in (1, 1, None)]), forest).collect()
    assert len({(r["n_words"], r["anomaly"], r["kept"]) for r in same}) == 1 and same[0]["n_words"] == 80_000


def test_every_document_shapes_the_forest_and_its_threshold(spark):
    """More documents than a sample of 4,096 held: the median, the trees and the rank of the threshold take all of them."""
    rng = np.random.default_rng(9)
    longs = rng.integers(2, 2000, 6000)
    docs = frame(spark, [(k, f"{'a' * int(n)} " + " ".join(f"w{k}x{i}" for i in range(50)), *(None,) * 6) for k, n in enumerate(longs)])
    stats = np.array([quality_rules.statistics(r["text"]) for r in docs.collect()])
    lengths = sorted(stats[:, 1] * 1_000_000 // stats[:, 0])
    labels = spark.createDataFrame([(k, 0, 1) for k in range(6000)], "doc_id long, toxic int, quality int")
    forest = quality_rules.train(docs, labels)
    assert forest.center == lengths[(6000 - 1) // 2] / 1_000_000
    score = np.sort(forest.score(quality_rules.features(stats, forest.center)))
    assert forest.threshold == pytest.approx(score[int(np.ceil(6000 * 0.998)) - 1] + 0.02, abs=1e-9)
    x = quality_rules.features(stats, forest.center)
    assert max(t[1].max() for t in forest.trees) <= x.max()
    parts = quality_rules.extents(quality_rules.joined([([-1], [0.0], [0], [0.0])] * 128), np.zeros(128, int), x, np.arange(6000), quality_rules.spread_of(6000))
    assert sum(n for _, n, _, _ in parts) == 6000 * quality_rules.spread_of(6000)
    numbers = spark.createDataFrame([(int(v),) for v in lengths[::7]], "length long")
    assert [quality_rules.ranked(numbers, "length", k) for k in (0, 400, 857)] == [lengths[::7][k] for k in (0, 400, 857)]


def test_quality_forest_grows_on_batches_without_an_open_node(spark):
    """A document isolated at once, in a batch of its own, reaches no open node while the others are still split."""
    data = [(k, " ".join(["a" * (5 + k)] * 20 + [f"w{k}x{i}" for i in range(60)])) for k in range(40)] + [(40, " ".join(["a" * 90_000] + [f"v{i}" for i in range(60)]))]
    docs = frame(spark, [(*x, *(None,) * 6) for x in data])
    labels = spark.createDataFrame([(k, 0, int(k < 40)) for k in range(41)], "doc_id long, toxic int, quality int")
    whole = quality_rules.train(docs, labels)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        forest = quality_rules.train(docs, labels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(forest.trees) == 128 and max(len(t[0]) for t in forest.trees) > 3
    assert forest.threshold == whole.threshold and all((a == b).all() for t, o in zip(forest.trees, whole.trees) for a, b in zip(t, o))


def test_quality_edges(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    forest = quality_rules.train(docs, labels)
    assert quality_rules.judge(docs, forest).count() == 0
    out = quality_rules.judge(frame(spark, [(None, None) + (None,) * 6] * 2), forest).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in out] == [(0, True, False)] * 2


def test_a_text_is_parsed_as_one(monkeypatch):
    """Blocks of any size give the phrases of a plain parse of the whole text."""
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    train = [" ".join(word("abcde") for _ in range(60)), " ".join(word("cdefgh") for _ in range(50))]
    model = language_id.learn([("aa", train[:1], train[:1]), ("bb", train[1:], train[1:])])
    texts = [train[0][7:90], train[1], "", "x", " ".join(word("abcdefgh") for _ in range(80)), train[0] * 3, train[1][:9] + train[0], "zzz" * 30]

    def phrases(text, own):
        sym, own = "".join(map(chr, language_id.symbols_of(text))), "".join("".join(map(chr, language_id.symbols_of(x))) for x in own)
        at = n = 0
        while at < len(sym):
            k = 1
            while at + k < len(sym) and sym[at : at + k + 1] in own:
                k += 1
            at, n = at + k, n + 1
        return n

    for block in (1, 2, 7, 1024):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", block)
        got = model.phrases(texts)[0]
        assert got.tolist() == [[phrases(x, train[:1]), phrases(x, train[1:])] for x in texts]


def test_large_alphabets_many_languages_and_short_texts(spark):
    """Han and Hangul beside Latin letters; three hundred languages; a text is judged by its figure, however short."""
    rng = random.Random(2)
    make = lambda points, n: "".join(chr(rng.choice(points)) for _ in range(n))
    han, hangul, latin = [0x4E00 + 7 * k for k in range(900)], [0xAC00 + 11 * k for k in range(700)], [97 + k for k in range(26)]
    common = {k: [make(p, rng.randint(1, 4)) for _ in range(150)] for k, p in (("zh", han), ("ko", hangul), ("en", latin))}
    say = lambda k, n: " ".join(rng.choice(common[k]) for _ in range(n))
    rows = [(i, say(k, 60), k) for i, k in enumerate(["zh", "ko", "en"] * 40)]
    model = language_id.train(frame(spark, [(*r, *(None,) * 5) for r in rows]), F.lit(True))
    assert [x[0] for x in model.predict([say(k, 8) for k in ("zh", "ko", "en")])] == ["zh", "ko", "en"]
    assert all(x[3] <= language_id.REJECT for x in model.predict([say(k, n) for k in common for n in (2, 4, 30)]))
    odd = "qjxz wvkq zxjq"
    short, long = model.predict([odd, " ".join([odd] * 30)])
    assert (short[3] <= language_id.REJECT) == (long[3] <= language_id.REJECT)
    words = {f"l{k:03d}": [make(latin, rng.randint(3, 8)) for _ in range(40)] for k in range(260)}
    many = [(i, " ".join(rng.choice(w) for _ in range(80)), k) for i, (k, w) in enumerate((k, w) for k, w in words.items() for _ in range(2))]
    model = language_id.train(frame(spark, [(*r, *(None,) * 5) for r in many]), F.lit(True))
    assert model.langs == sorted(words)
    hits = [x[0] for x in model.predict([" ".join(rng.choice(words[k]) for _ in range(30)) for k in sorted(words)[::20]])]
    assert sum(a == b for a, b in zip(hits, sorted(words)[::20])) >= 12
