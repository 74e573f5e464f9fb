"""Porter's stemmer (M. F. Porter, 1980), by rules, as an Arrow UDF over token arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: suffix rules of steps 2 to 4
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(s: str) -> str:
    out = ""
    for ch in s:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _kinds(s)))


def _vowel(s: str) -> bool:
    return "v" in _kinds(s)


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _kinds(s)[-1] == "c"


def _cvc(s: str) -> bool:
    return _kinds(s).endswith("cvc") and s[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((x for x in suffixes if w.endswith(x)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Stem of a lower-case word."""
    if len(w) < 3:
        return w
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((x for x in ("ed", "ing") if w.endswith(x) and _vowel(w[: -len(x)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(w, rules)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, [*STEP4, "ion"])
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of arrays of words."""
    return tokens.map(lambda x: None if x is None else [stem(w) for w in x])
