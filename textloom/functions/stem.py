"""English stemming by the published suffix-stripping algorithm of M. F. Porter (1980), as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what takes their place where the stem before has a measure above 0 (fixed values of the algorithm).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where the measure is above 1 (fixed values).
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_LONGEST = {name: re.compile("(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$") for name, suffixes in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for name, table in (("2", STEP_2), ("3", STEP_3)):
        found = _LONGEST[name].search(word)
        if found and _measure(word[: found.start()]):
            word = word[: found.start()] + table[found[1]]
    found = _LONGEST["4"].search(word)
    if found:
        rest = word[: found.start()]
        if _measure(rest) > 1 and (found[1] != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(tokens: Column, exceptions: dict[str, str] | None = None, least: int = 0) -> Column:
    """Tokens stemmed, but for those of ``exceptions``, which become what it says, and those of ``least`` letters or fewer."""
    known = exceptions or {}

    def run(rows: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(word: str) -> str:
            if len(word) <= least:
                return word
            if word not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[word] = known.get(word) or stem(word)
            return memo[word]

        return pd.Series([None if r is None else [one(w) for w in r] for r in rows])

    return F.pandas_udf(run, "array<string>")(tokens)


def exception_table(lines: Iterable[str]) -> dict[str, str]:
    """Irregular forms: each line holds a form and the words it comes from, of which the first counts."""
    return {f[0]: f[1] for f in (line.split() for line in lines) if len(f) > 1}
