"""The Porter2 (Snowball English) stemmer.

Words are stemmed once each: distinct words go through one vectorised function and are joined back. Words of up to two
letters and words beyond ASCII stay as they are; nothing is lower-cased. The first steps are there as columns, too.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
R1_PREFIXES = {"gener": 5, "arsen": 5, "commun": 6}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile(r"(?:.*[^aeiouy][aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])$")


def mark_consonant_y(word: Column) -> Column:
    """Y for a y that stands first or after a vowel."""
    return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")


def step_0(word: Column) -> Column:
    """Without a possessive ending."""
    return F.regexp_replace(word, "('s'|'s|')$", "")


def step_1a(word: Column) -> Column:
    """Without a plural ending."""
    cut = lambda n: F.left(word, F.length(word) - n)
    return (
        F.when(word.endswith("sses"), cut(2))
        .when(word.endswith("ied") | word.endswith("ies"), F.concat(cut(3), F.when(F.length(word) > 4, "i").otherwise("ie")))
        .when(word.endswith("us") | word.endswith("ss"), word).when(word.endswith("s") & cut(1).rlike("[aeiouy]."), cut(1)).otherwise(word)
    )


def _after_region(word: str, start: int) -> int:
    m = _REGION.match(word, start)
    return m.end() if m else len(word)


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again from there."""
    r1 = next((n for p, n in R1_PREFIXES.items() if word.startswith(p)), None)
    r1 = _after_region(word, 0) if r1 is None else r1
    return r1, _after_region(word, r1)


def is_short(word: str) -> bool:
    """Ends with a short syllable, and R1 is empty."""
    return bool(_SHORT.match(word)) and regions(word)[0] >= len(word)


def _replaced(word: str, table: dict[str, str], allowed) -> str:
    """The longest ending of the table that the word has is replaced if that is allowed; then nothing else is tried."""
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            return word[: -len(end)] + table[end] if allowed(end, len(word) - len(end)) else word
    return word


def stem(word: str | None) -> str | None:
    """The stem of one word."""
    if word is None or len(word) <= 2 or not word.isascii():
        return word
    w = word.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1, r2 = regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in INVARIANT:
        return w
    # 1b: past and present participles
    if w.endswith(("eed", "eedly")):
        end = 5 if w.endswith("ly") else 3
        w = w[: len(w) - end + 2] if len(w) - end >= r1 else w
    else:
        end = next((e for e in ("ed", "edly", "ing", "ingly") if w.endswith(e)), None)
        if end and re.search("[aeiouy]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif is_short(w):
                w += "e"
    # 1c: a final y after a consonant that is not the first letter
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    before = {"ogi": "l", "li": LI_ENDINGS}
    w = _replaced(w, STEP_2, lambda e, n: n >= r1 and (e not in before or w[:n].endswith(tuple(before[e]))))
    w = _replaced(w, STEP_3, lambda e, n: n >= r1 and (e != "ative" or n >= r2))
    # 4: the first ending of the list that the word has
    end = next((e for e in STEP_4 if w.endswith(e)), None)
    if end:
        w = w[: -len(end)] if len(w) - len(end) >= r2 else w
    elif w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
        w = w[:-3]
    # 5: a final e or l
    if w.endswith("l"):
        w = w[:-1] if len(w) - 1 >= r2 and w[-2:-1] == "l" else w
    elif w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stems(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) of distinct words."""
    from aspectra.functions.workers import ship_package

    ship_package(words.sparkSession)
    return words.select(F.col(column).alias("word")).distinct().select("word", stem_column("word").alias("stem"))
