"""Toxicity: logistic regression that identity terms cannot move.

Features are the words of a text and their prefixes of 4 to 6 characters, present or not. Of a
bounded labelled sample, features that are much likelier in toxic texts are kept, and a logistic
regression is fitted on them. Its counterfactuals are labelled texts with an identity term, as they
are and with `MENTIONS` copies of labelled texts into which a term is put (by chance, as groups are named
unevenly in any sample): of each, further copies swap the term for others of its kind, and the squared
change of the score's logit between a text and its copies is added to the loss. Neutral mentions of a
group therefore hardly change a score; `swing` measures by how much they do.

Bounds: `SAMPLE` labelled documents of each class in the order of a hash, `FEATURES` features,
`MENTIONS` texts with a term put in, `SWAPS` copies of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm.tables import sampled, single
from recallspark.sources.staging import staged

SAMPLE, FEATURES, MENTIONS, SWAPS = 3000, 1024, 1500, 4
MIN_DOCS, MIN_RATIO = 5, 3.0
#: Rounds at most; they end when no weight moves by more than `STILL`.
ROUNDS, STILL = 3000, 1e-6
RATE, DECAY, PENALTY = 1.0, 3e-5, 1.0
THRESHOLD = 0.7
#: Words whose weights are kept at hand in a task.
CACHE = 300_000

#: Identity terms by kind and language; terms of one kind and language are swapped for each other.
IDENTITY = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    "gender": ("woman", "man", "women", "men", "transgender"),
    "orientation": ("gay", "lesbian", "bisexual", "straight"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab"),
    "race": ("black", "white", "latino"),
    "age": ("young", "old", "elderly"),
    "religion de": ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    "gender de": ("frau", "mann", "frauen", "männer"),
    "origin de": ("afrikaner", "asiate", "europäer", "amerikaner", "araber", "türke"),
    "religion fr": ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    "gender fr": ("femme", "homme", "femmes", "hommes"),
    "origin fr": ("africain", "asiatique", "européen", "américain", "arabe", "maghrébin"),
    "religion es": ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    "gender es": ("mujer", "hombre", "mujeres", "hombres"),
    "origin es": ("africano", "asiático", "europeo", "americano", "árabe", "mexicano"),
}

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def swaps(bag: set[str], identity: dict[str, tuple[str, ...]] = IDENTITY) -> list[set[str]]:
    """The features of the text with one identity term swapped for another of its kind."""
    out = []
    for terms in identity.values():
        for term in terms:
            if term in bag:
                rest = bag.difference(features_of(term))
                out += [rest.union(features_of(other)) for other in terms if other not in bag]
    return out[:: max(1, len(out) // SWAPS)][:SWAPS]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def logit(self, words: set[str], cache: dict[str, tuple]) -> float:
        total, seen = self.bias, set()
        for w in words:
            x = cache.get(w)
            if x is None:
                if len(cache) >= CACHE:
                    cache.clear()
                x = cache[w] = tuple(f for f in features_of(w) if f in self.weights)
            if x:
                seen.update(x)
        return total + sum(self.weights[f] for f in sorted(seen))


def mentions(bags: list[set[str]], identity: dict[str, tuple[str, ...]], most: int = MENTIONS) -> list[tuple[int, set[str]]]:
    """(number of the text, its features with an identity term put in) for at most `most` texts."""
    rng = np.random.default_rng(5)
    terms = [t for kind in identity.values() for t in kind]
    some = sorted(rng.permutation(len(bags))[:most].tolist())
    return [(k, bags[k].union(features_of(terms[i]))) for k, i in zip(some, rng.integers(0, len(terms), len(some)).tolist())]


class Rows:
    """A sparse matrix by its entries."""

    def __init__(self, n: int, width: int, row: list[int], col: list[int], value: list[float]):
        self.n, self.width = n, width
        self.row, self.col, self.value = np.array(row, np.int64), np.array(col, np.int64), np.array(value, float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.width)


def _rows(bags: list[set[str]], at: dict[str, int], less: list[set[str]] | None = None) -> Rows:
    """A row a bag: 1 for each feature in it, -1 for those of `less` (common features cancel)."""
    row, col, value = [], [], []
    for k, bag in enumerate(bags):
        out = less[k] if less else set()
        for some, v in ((bag - out, 1.0), (out - bag, -1.0)):
            found = [at[f] for f in sorted(some) if f in at]
            row += [k] * len(found)
            col += found
            value += [v] * len(found)
    return Rows(len(bags), len(at), row, col, value)


def fit(bags: list[set[str]], toxic: list[int], names: list[str], identity: dict[str, tuple[str, ...]] = IDENTITY, penalty: float = PENALTY) -> Model:
    """Logistic regression on the features `names`, with the penalty on swapped copies."""
    if not 0 < sum(toxic) < len(toxic):
        return Model({}, 4.0 if any(toxic) else -4.0)
    at = {f: k for k, f in enumerate(names)}
    named = mentions(bags, identity)
    bags, toxic = bags + [bag for _, bag in named], toxic + [toxic[k] for k, _ in named]
    y = np.array(toxic, float)
    yes, no = int(y.sum()), int(len(y) - y.sum())
    x = _rows(bags, at)
    pairs = [(bag, copy) for bag in bags for copy in swaps(bag, identity)]
    change = _rows([a for a, _ in pairs], at, [b for _, b in pairs])
    each = 1 / max(1, len(pairs))
    w, b = np.zeros(len(names)), 0.0
    speed, slow, weight = np.zeros_like(w), 0.0, np.where(y == 1, 0.5 / yes, 0.5 / no)
    size = np.bincount(change.row, np.abs(change.value), change.n)
    steep = np.bincount(change.col, np.abs(change.value) * size[change.row], change.width).max(initial=0.0) * each
    step = RATE / (1 + penalty * steep)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30)))
        g = (p - y) * weight
        speed = 0.9 * speed + x.back(g) + DECAY * w + 2 * penalty * each * change.back(change.times(w))
        slow = 0.9 * slow + float(g.sum())
        w, b = w - step * speed, b - RATE * slow
        if max(step * np.abs(speed).max(initial=0.0), RATE * abs(slow)) < STILL:
            break
    return Model({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3}, float(b))


def swing(model: Model, texts: list[str], identity: dict[str, tuple[str, ...]] = IDENTITY) -> float:
    """Mean spread of the logit of a text over the terms of a kind put behind it."""
    found, cache = [], {}
    for k, text in enumerate(texts):
        terms = list(identity.values())[k % len(identity)]
        logits = [model.logit(words_of(f"{text} {t}"), cache) for t in terms]
        found.append(max(logits) - min(logits))
    return float(np.mean(found)) if found else 0.0


def chosen(bags: DataFrame, identity: dict[str, tuple[str, ...]] = IDENTITY) -> list[str]:
    """Features of (toxic, features) that are much likelier in toxic texts, at most FEATURES, and those
    of the identity terms, so that the penalty has what to act on."""
    sizes = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    one = bags.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("c"), F.sum(1 - F.col("toxic")).alias("o"))
    ratio = ((F.col("c") + 0.5) / (sizes.get(1, 0) + 1)) / ((F.col("o") + 0.5) / (sizes.get(0, 0) + 1))
    best = one.where(F.col("c") + F.col("o") >= MIN_DOCS).withColumn("r", ratio).where(F.col("r") >= MIN_RATIO)
    names = [r["f"] for r in best.orderBy(F.desc(F.col("c") * F.log("r")), "f").limit(FEATURES).collect()]
    return names + sorted({f for terms in identity.values() for t in terms for f in features_of(t)} - set(names))


def train(docs: DataFrame, labels: DataFrame, usable, penalty: float = PENALTY) -> Model:
    """Model of labelled documents (toxic 1 or 0) for which `usable` holds."""
    marks = labels.where("toxic is not null and doc_id is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [sampled(marks, marks.where(F.col("toxic") == k), SAMPLE) for k in (0, 1)]
    ids = some[0].unionByName(some[1])  # at most 2 * SAMPLE rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in words_of(x.as_py()) for f in features_of(w)}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    rows = single(rows, "toxic").select("doc_id", "text", "toxic")
    table = staged(rows.mapInArrow(bags, "doc_id long, toxic int, features array<string>"), "bags")
    names = chosen(table)
    known = set(names)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f for f in x.as_py() if f in known] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    found = table.mapInArrow(kept, "doc_id long, toxic int, features array<string>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    return fit([set(r["features"]) for r in found], [r["toxic"] for r in found], names, penalty=penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) and predicted (1 from THRESHOLD on).

    Empty and NULL texts get the score of a text without any feature; NULL doc_ids and repeated rows
    are scored like any other; an empty table gives an empty result; other columns are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            logit = np.array([share.value.logit(words_of(x.as_py()), cache) for x in batch.column(1)], float)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(task, "doc_id long, score double, predicted int")
