"""Small corpora with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, spans string, gone string"


def texts(seed: int = 5) -> list[str | None]:
    """Random prose with shared passages, copies, near copies, repeats, empty, NULL and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ日") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [prose(45), prose(30), "\n".join(prose(5) for _ in range(6))]
    out: list[str | None] = [None, "", " ", "\n\n\n", "one", prose(19), prose(20)]
    for k in range(26):
        parts = [prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        if k % 2:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        if k % 5 == 0:
            parts += [parts[0], parts[0]]
        out.append(rng.choice([" ", "\n", "\t", " \r\n"]).join(parts))
    copy = prose(50)
    out += [copy] * 12 + [copy + " end", copy.upper()]
    out += ["again and again " * 300, "x" * 3000, shared[2] + "\n" + shared[2], prose(6000)]
    return out


def rows(seed: int = 5) -> list[tuple]:
    found = texts(seed)
    rng = random.Random(seed)
    ids = list(range(len(found)))
    rng.shuffle(ids)
    return [(i, x, "aa", "s", len(x or ""), -1, "clash", "clash") for i, x in zip(ids, found)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def covered(docs: list[tuple[int, list]], width: int, earlier: bool) -> dict[int, set[int]]:
    """Positions covered by windows that also start earlier (or anywhere else)."""
    places: dict[tuple, list] = {}
    for did, sym in sorted(docs):
        for i in range(len(sym) - width + 1):
            places.setdefault(tuple(sym[i : i + width]), []).append((did, i))
    out: dict[int, set[int]] = {did: set() for did, _ in docs}
    for where in places.values():
        for did, i in where[1:] if earlier else where if len(where) > 1 else ():
            out[did].update(range(i, i + width))
    return out


def line_hash(x) -> int:
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def lines_deleted(docs: list[tuple], noise: int, reach: int, extend: bool = True) -> dict:
    """Numbers of the lines that winnowing deletes from (key, text) in order, by plain loops: those of the longest
    run that each selected place has in common with any earlier place of its unit."""
    own, places = {}, {}
    for key, text in docs:
        found = [(n, len(WORD.findall(x.encode())), line_hash(x)) for n, x in enumerate(text.split("\n"))]
        own[key] = found = [x for x in found if x[1]]

        def count(i, words):
            total = 0
            for k in range(i, len(found)):
                total += found[k][1]
                if total >= words:
                    return k - i + 1
            return None

        size = [count(i, noise) for i in range(len(found))]
        unit = [k and line_hash(",".join(str(x[2]) for x in found[i : i + k])) for i, k in enumerate(size)]
        at = set()
        for i in range(len(found)):
            some = [(unit[j], j) for j in range(i, min(len(found), i + (count(i, reach) or reach))) if unit[j] is not None]
            if some:
                at.add(min(some)[1])
        for p in sorted(at):
            places.setdefault(unit[p], []).append((key, p, size[p]))
    gone = {key: set() for key, _ in docs}
    for same in places.values():
        for n, (key, p, k) in enumerate(same):
            a = [x[2] for x in own[key]]
            for key1, p1, _ in same[:n]:
                b = [x[2] for x in own[key1]]
                left = right = 0
                while left < min(p, p1) and a[p - left - 1] == b[p1 - left - 1]:
                    left += 1
                while p + right < len(a) and p1 + right < len(b) and a[p + right] == b[p1 + right]:
                    right += 1
                gone[key] |= {own[key][i][0] for i in (range(p - left, p + right) if extend else range(p, p + k))}
    return gone
