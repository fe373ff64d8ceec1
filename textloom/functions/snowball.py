"""The English stemmer of the Snowball project (Porter 2) and the text normaliser built on it, as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as tx

#: Forms with stems of their own, and forms that stay after step 1a (fixed values of the algorithm).
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYING = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts (fixed values).
REGION_STARTS = ("gener", "commun", "arsen")
#: Suffixes of step 2 and 3 and what takes their place in the first region (fixed values).
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes that go in the second region (fixed values).
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: English stop words (fixed values); parts of contractions are listed as punctuation leaves them.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split())

_VOWELS = "aeiouy"
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT_END = re.compile(f"(?:[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$")
_LONGEST = {k: re.compile("(?:" + "|".join(sorted(v, key=len, reverse=True)) + ")$") for k, v in ((2, STEP_2), (3, STEP_3), (4, STEP_4))}


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first non-vowel after a vowel."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.replace("’", "'").removeprefix("'")
    # A y that begins the word or follows a vowel is a consonant, written Y.
    word = re.sub(f"(?:^y|(?<=[{_VOWELS}])y)", "Y", word)
    start = next((len(p) for p in REGION_STARTS if word.startswith(p)), None)
    r1 = _after(word, 0) if start is None else start
    r2 = _after(word, r1)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    word = _plural(word)
    if word in STAYING:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if not _has_vowel(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                return rest[:-1]
            return rest + "e" if len(rest) <= r1 and _SHORT_END.search(rest) else rest
    return word


def _derived(word: str, r1: int, r2: int) -> str:
    found = _LONGEST[2].search(word)
    if found and found.start() >= r1:
        suffix, before = found[0], word[: found.start()]
        if (suffix != "ogi" or before.endswith("l")) and (suffix != "li" or before.endswith(tuple("cdeghkmnrt"))):
            word = before + STEP_2[suffix]
    found = _LONGEST[3].search(word)
    if found and found.start() >= r1 and (found[0] != "ative" or found.start() >= r2):
        word = word[: found.start()] + STEP_3[found[0]]
    found = _LONGEST[4].search(word)
    if found and found.start() >= r2 and (found[0] != "ion" or word[: found.start()].endswith(("s", "t"))):
        word = word[: found.start()]
    return word


def stemmed(tokens: Column) -> Column:
    """The stems of a column of token arrays; null arrays stay null, null tokens go."""

    def run(rows: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(word: str) -> str:
            if word not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[word] = stem(word)
            return memo[word]

        return pd.Series([None if r is None else [one(w) for w in r if w is not None] for r in rows])

    return F.pandas_udf(run, "array<string>")(tokens)


def normalised(text: Column, remove_stop_words: bool = False, stems: bool = True) -> Column:
    """Lower-cased words without punctuation; stop words go before stemming."""
    words = tx.tokens(text)
    if remove_stop_words:
        words = F.filter(words, lambda x: ~x.isin(*STOP_WORDS))
    return stemmed(words) if stems else words
