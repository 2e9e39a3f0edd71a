"""Language ID by cross-parsing: suffix automata of labelled text, longest matches, fewest phrases.

For each language, the suffix automaton of a bounded stretch of its labelled text recognises exactly
the substrings of that text. A document is parsed from left to right into phrases: the longest match
in the automaton is one phrase, and the next phrase starts behind it (a character that the language
does not have is a phrase by itself). Phrases a character times log2 of the training length estimate
the cross entropy (Ziv and Merhav); divided by the rate that the language's own text needs, the
language with the smallest figure wins.

Whole texts are parsed, in blocks of `BLOCK_CHARS` characters that are stepped together through dense
transition tables, in which a missing transition already holds the restart of the parse. A block is then
entered again in the state its predecessor ended in, until both parses begin a phrase at one place (which they
do after a few phrases): the result is that of one parse of the whole text, whatever the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.tables import single

#: Bounds of the training sample, for each language: characters taken (fewer if the languages together exceed
#: `TRAIN_TOTAL`), documents they come from, and documents (others, if there are) that its own rate is measured on.
TRAIN_CHARS, TRAIN_TOTAL, TRAIN_DOCS, RATE_DOCS = 16_000, 1_000_000, 64, 64
#: Characters taken of one document of the sample, from a place given by a hash, so that several make it up.
DOC_CHARS = 2_000
#: Symbols of a language at most; the code points of a larger alphabet share them by a hash. What does not occur in the
#: training text of a language is a symbol that it does not have.
SYMBOLS = 255
BLOCK_CHARS, LANES = 1024, 4096
#: A document whose best figure, without its last phrase, is above this is in none of the languages.
REJECT = 2.5


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(65536)])


LETTER = _letter_table()


def symbols_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a run of anything but letters is one space."""
    sym = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    other = ~LETTER[np.minimum(sym, 65535)] & (sym < 65536)
    sym = np.where(other, np.uint32(32), sym)
    other[1:] &= other[:-1]
    return sym[~other] if len(sym) else sym


def _letters(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(c.isalpha() for c in text))


def automaton(sym: np.ndarray, sigma: int) -> np.ndarray:
    """Transitions (state, symbol) of the suffix automaton, -1 where there is none; state 0 starts."""
    size = 2 * len(sym) + 2
    go = np.full((size, sigma), -1, np.int32)
    link, length = np.full(size, -1), np.zeros(size, np.int64)
    last, n = 0, 1
    for c in sym.tolist():
        cur, n = n, n + 1
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and go[p, c] < 0:
            go[p, c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = go[p, c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, n = n, n + 1
                length[clone], go[clone], link[clone] = length[p] + 1, go[q], link[q]
                while p >= 0 and go[p, c] == q:
                    go[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go[:n]


def alphabet(texts: list[str]) -> tuple[np.ndarray, int]:
    """Symbol of each code point below 65536 (0: not in the texts), and the number of symbols with 0."""
    used = np.zeros(65536, bool)
    for x in texts:
        sym = symbols_of(x)
        used[sym[sym < 65536]] = True
    points = np.flatnonzero(used)
    codes = np.zeros(65536, np.uint8)
    codes[points] = np.arange(len(points)) + 1 if len(points) <= SYMBOLS else points * 40503 % 65521 % SYMBOLS + 1
    return codes, int(codes.max(initial=0)) + 1


@dataclass
class Model:
    langs: list[str]
    codes: list[np.ndarray]  # for each language, the symbol of each code point below 65536; 0: it does not have it
    sigma: list[int]  # number of symbols
    go: list[np.ndarray]  # flat (state, symbol) -> state, negative: a new phrase began
    scale: np.ndarray  # figure of one phrase a character

    def phrases(self, texts: list[str], langs: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language (all, or those numbered), and characters (one at least) of each text."""
        cut, owner, chars, before = [], [], np.ones(len(texts)), []
        for k, text in enumerate(texts):
            sym = symbols_of(text)
            chars[k] = max(1, len(sym))
            sym = np.minimum(sym, 65535).astype(np.uint16)  # U+FFFF is no letter
            for a in range(0, max(1, len(sym)), BLOCK_CHARS):
                before.append(len(cut) - 1 if a else -1)
                cut.append(sym[a : a + BLOCK_CHARS])
                owner.append(k)
        size, before, owner = np.array([len(x) for x in cut], np.int64), np.array(before, np.int64), np.array(owner, np.int64)
        order = np.argsort(-size, kind="stable")
        most = int(size.max(initial=0))
        grid = np.full((most, len(cut)), 65535, np.uint16)  # columns by falling size
        for k, x in enumerate(order):
            grid[: size[x], k] = cut[x]
        place = np.empty(len(cut), np.int64)
        place[order] = np.arange(len(cut))
        size, before, owner = size[order], np.where(before[order] >= 0, place[before[order]], -1), owner[order]
        out = np.zeros((len(texts), len(self.langs)))
        for lang in range(len(self.langs)) if langs is None else langs:
            count, begun, state = self._fresh(lang, grid, size)
            self._joined(lang, grid, size, before, count, begun, state)
            np.add.at(out[:, lang], owner, count)
        return out, chars

    def _fresh(self, lang: int, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each block by itself, where they begin, and the state at its end."""
        go, sigma, codes = self.go[lang], self.sigma[lang], self.codes[lang]
        count, state, begun = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(grid.shape, bool)
        for a in range(0, len(size), LANES):
            lanes = slice(a, a + LANES)
            active = np.searchsorted(-size[lanes], -np.arange(len(grid)), "left")
            for t in range(int(size[a])):
                w = slice(a, a + active[t])
                to = go[state[w] * sigma + codes[grid[t, w]]]
                new = to < 0
                begun[t, w] = new
                count[w] += new
                state[w] = np.where(new, ~to, to)
        return count, begun, state

    def _joined(self, lang: int, grid, size, before, count, begun, state) -> None:
        """Counts of blocks that go on where their predecessors ended. A block whose end changes by that is followed by
        another round for its successor."""
        go, sigma, codes = self.go[lang], self.sigma[lang], self.codes[lang]
        after = np.full(len(size), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        fresh, own, todo = count.copy(), state.copy(), np.flatnonzero(before >= 0)
        while len(todo):
            lanes, now = todo, state[before[todo]]
            done, seen, ends = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), []
            t = 0
            while len(lanes):
                over = size[lanes] <= t
                if over.any():  # never met its fresh parse: its own end counts
                    ends.append((lanes[over], done[over], now[over]))
                    lanes, now, done, seen = lanes[~over], now[~over], done[~over], seen[~over]
                    continue
                to = go[now * sigma + codes[grid[t, lanes]]]
                new, was = to < 0, begun[t, lanes]
                done += new
                seen += was
                now = np.where(new, ~to, to)
                met = new & was
                ends.append((lanes[met], fresh[lanes[met]] - seen[met] + done[met], own[lanes[met]]))
                lanes, now, done, seen = lanes[~met], now[~met], done[~met], seen[~met]
                t += 1
            todo = np.zeros(0, np.int64)
            for some, phrases, end in ends:
                count[some] = phrases
                moved = some[state[some] != end]
                state[some] = end
                todo = np.append(todo, after[moved][after[moved] >= 0])

    def rates(self, texts: list[str], langs: list[int] | None = None) -> np.ndarray:
        """Phrases a character, by text and language."""
        found, chars = self.phrases(texts, langs)
        return found / chars[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """(language, score, figure, the figure without the last phrase, which the end of the text cuts) of each text."""
        known = [k for k, x in enumerate(texts) if _letters(x)]
        out = [("und", 0.0, float("inf"), float("inf"))] * len(texts)
        if not self.langs or not known:
            return out
        found, chars = self.phrases([texts[k] for k in known])
        figures = found / chars[:, None] * self.scale
        best = figures.argmin(axis=1)
        rest = np.sort(figures, axis=1)
        for row, k in enumerate(known):
            first, second = rest[row, 0], rest[row, 1] if len(self.langs) > 1 else rest[row, 0] + 1
            less = (found[row, best[row]] - 1) / chars[row] * self.scale[best[row]]
            out[k] = (self.langs[best[row]], float(second / (first + second)) if second > 0 else 0.5, float(first), float(less))
        return out


def learn(samples: list[tuple[str, list[str], list[str]]]) -> Model:
    """Model of (language, texts to learn, texts to measure its own rate on)."""
    model = Model([x[0] for x in samples], [], [], [], np.ones(len(samples)))
    for _, texts, _ in samples:
        codes, sigma = alphabet(texts)
        go = automaton(np.concatenate([codes[np.minimum(symbols_of(x), 65535)] for x in texts] or [np.zeros(0, np.uint8)]).astype(np.int64), sigma)
        start = np.where(go[0] >= 0, go[0], 0)
        start[0] = 0
        go = np.where(go >= 0, go, ~start[None, :].astype(np.int32))
        go[0] = ~start  # from the start state every character begins a phrase
        go[:, 0] = ~0  # a character it does not have is a phrase, and the next one begins another
        model.codes.append(codes)
        model.sigma.append(sigma)
        model.go.append(go.reshape(-1))
    for k, (_, texts, own) in enumerate(samples):
        rate = model.rates(own or texts, [k])[:, k] if own or texts else np.ones(1)
        model.scale[k] = 1 / max(1e-6, float(np.median(rate)))
    return model


def labelled(docs: DataFrame, usable) -> list[tuple[str, list[str], list[str]]]:
    """A bounded sample of labelled rows: for each language, documents in the order of a hash."""
    rows = docs.where(usable).where("doc_id is not null and lang is not null and length(text) >= 20")
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the first of each language, cut before the exchange; their ids are a bounded broadcast
    ids = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(place)).where(F.col("n") <= TRAIN_DOCS + RATE_DOCS).select("doc_id").distinct()
    some = single(rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi"), "lang")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - DOC_CHARS + 1))
    some = some.select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", start.cast("int"), F.lit(DOC_CHARS)).alias("text")).collect()
    by_lang: dict[str, list] = {}
    for r in some:
        by_lang.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out, most = [], min(TRAIN_CHARS, TRAIN_TOTAL // max(1, len(by_lang)))
    for lang in sorted(by_lang):
        texts = list(dict.fromkeys(x[1] for x in sorted(by_lang[lang])))
        half = max(1, len(texts) // 2)
        train, left = [], most
        for x in texts[:half]:
            if left > 0:
                train.append(x[:left])
                left -= len(x)
        out.append((lang, train, texts[half:]))
    return out


def train(docs: DataFrame, usable) -> Model:
    return learn(labelled(docs, usable))


def held_out(modulus: int, rest: int):
    """Whether crc32 of the doc_id as text leaves `rest`; a NULL doc_id counts as the empty text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus == rest


def usable_rows():
    return ~held_out(4, 2)


def identify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (second / (first + second) of the figures), figure (1: as the
    language's own text) and, with keep_text, the text.

    `und`, score 0 and no figure if the text is NULL or has no letter, or if nothing was learned.
    Extra columns of the input are ignored; repeated rows and ties give equal results (the language
    that comes first by name wins a tie); an empty table gives an empty result.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = share.value.predict(batch.column(1).to_pylist())
                cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([None if np.isinf(x[2]) else x[2] for x in found], pa.float64())]
                names = ["doc_id", "lang_pred", "score", "figure"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *([batch.column(1)] if keep_text else [])], names=names + ["text"] * keep_text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, lang_pred string, score double, figure double" + ", text string" * keep_text)


def keep_identified(docs: DataFrame, model: Model, most: float = REJECT) -> DataFrame:
    """The documents, all columns, that are in one of the learned languages."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), 512):
            part = [None if x is None else x for x in text.iloc[at : at + 512]]
            out += [x[0] != "und" and x[3] <= most for x in share.value.predict(part)]
        return pd.Series(out, dtype=bool)

    return docs.where(known("text"))
