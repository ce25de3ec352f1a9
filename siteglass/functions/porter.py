"""Porter's suffix-stripping stemmer (1980), with diacritics removed, as a pandas UDF over arrays of words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published suffix rules, (suffix, replacement), longest first within a step.
STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _shape(word: str) -> str:
    """c and v for every letter; y counts as a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules, least: int) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            return head + new if _measure(head) > least else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ing", "ed"):
            if word.endswith(suffix):
                head = word[: -len(suffix)]
                if "v" in _shape(head):
                    word = head
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word[-2:-1] == word[-1:] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _closed(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2, 0), STEP3, 0)
    for suffix in (*STEP4, "ion"):
        if word.endswith(suffix) and (suffix != "ion" or word[:-3].endswith(("s", "t"))):
            if _measure(word[: -len(suffix)]) > 1:
                word = word[: -len(suffix)]
            break
    if word.endswith("e"):
        head = word[:-1]
        if _measure(head) > 1 or (_measure(head) == 1 and not _closed(head)):
            word = head
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def plain(word: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            p = plain(w)
            known[w] = porter(p) if p.isascii() else p
        return known[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])
