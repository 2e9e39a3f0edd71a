"""Column expressions over names and keys."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _changed(rule: Callable[[str], str]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that a rule makes another one of, and those it makes several of."""
    made = [(c, rule(c)) for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1)))]
    return {c: x for c, x in made if x != c and len(x) == 1}, {c: x for c, x in made if len(x) > 1}


def _mapped(text: Column, rule: Callable[[str], str]) -> Column:
    """Text with each character replaced by what `rule` makes of it. Characters that become one are translated; the few
    that become several are looked up, and only in texts that hold one."""
    one, many = _changed(rule)
    wide = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spread = F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(wide, c), c)), "")
    held = F.length(F.translate(text, "".join(many), "")) < F.length(text)  # a look-up a character; a class of so many is tried one by one
    return F.translate(F.when(held, spread).otherwise(text), "".join(one), "".join(one.values()))


def case_folded(text: Column) -> Column:
    """Full case folding, one letter to several included, as Unicode defines it."""
    return _mapped(text, str.casefold)


#: What separates words: every character that Unicode counts as white space.
_SPACE = "[" + "".join(f"\\x{{{i:X}}}" for i in range(0x3001) if chr(i).isspace()) + "]+"


def normalised(name: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends; case folded."""
    return case_folded(F.trim(F.regexp_replace(name, _SPACE, " ")))


def match_rank(name: Column, text: str, prefix: str | None = None, part: str | None = None) -> Column:
    """0 exact, 1 prefix, 2 contained, NULL otherwise; metacharacters are literal."""
    prefix, part = prefix or text, part or text
    return F.when(name == text, 0).when(F.startswith(name, F.lit(prefix)), 1).when(F.contains(name, F.lit(part)), 2)


def same_name_key(name: Column) -> Column:
    return normalised(F.translate(name, "_", " "))


def short_label(key: Column) -> Column:
    return F.concat(F.lit("Person "), F.upper(F.substring(key, 1, 6)))


def hash_remainder(key: Column, salt: str, n: int) -> Column:
    """sha256 of "salt:key" as a number, modulo n."""
    digits = F.split(F.sha2(F.concat(F.lit(f"{salt}:"), key).cast("binary"), 256), "")
    digits = F.filter(digits, lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda rest, c: (rest * 16 + F.conv(c, 16, 10).cast("int")) % n)


def _ascii(c: str) -> str:
    """The ASCII part of a character's compatibility decomposition; itself if it has none."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii()) or c


def plain_ascii(text: Column) -> Column:
    """Compatibility decomposition without what is not ASCII: marks come off letters, ligatures, full-width forms and
    numbers in circles fall apart, all else goes."""
    return F.regexp_replace(_mapped(text, _ascii), r"[^\x00-\x7F]", "")


def slug(name: Column) -> Column:
    """ASCII letters and digits, all else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(plain_ascii(name), "[^A-Za-z0-9]+", "_"), "^_|_$", "")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields in the order of their names, without blanks; NULL fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
