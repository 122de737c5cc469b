"""Phonetic keys and string similarity, as Arrow functions: Spark's soundex and levenshtein are other measures."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Each rule, tried in order at a place of the word: what must stand before, what is matched, what must follow, the code that it gives.
# A letter's sound by its neighbours. ^ is the word's start, $ its end.
_RULES = [
    (re.compile(pattern), code)
    for pattern, code in (
        (r"(?<=([ABD-Z]))\1", ""),
        (r"(?<!.)[AEIOU]", None),
        (r"[AEIOU]", ""),
        (r"(?<=M)B$", ""),
        (r"B", "B"),
        (r"C(?=IA)", "X"),
        (r"(?<=S)CH", "K"),
        (r"CH", "X"),
        (r"(?<=S)C(?=[IEY])", ""),
        (r"C(?=[IEY])", "S"),
        (r"C", "K"),
        (r"DG(?=[EYI])", "J"),
        (r"D", "T"),
        (r"GH(?=$|[AEIOU])", "K"),
        (r"GH", ""),
        (r"G(?=N)", ""),
        (r"G(?=[IEY])", "J"),
        (r"G", "K"),
        (r"(?<=[AEIOU])H(?![AEIOU])", ""),
        (r"(?<=[CSPTG])H", ""),
        (r"[FHJLMNR]", None),
        (r"(?<=C)K", ""),
        (r"K", "K"),
        (r"PH", "F"),
        (r"P", "P"),
        (r"Q", "K"),
        (r"SH", "X"),
        (r"S(?=I[OA])", "X"),
        (r"S", "S"),
        (r"T(?=I[OA])", "X"),
        (r"TH", "0"),
        (r"T(?=CH)", ""),
        (r"T", "T"),
        (r"V", "F"),
        (r"[WY](?=[AEIOU])", None),
        (r"[WY]", ""),
        (r"X", "KS"),
        (r"Z", "S"),
    )
]
# Openings of a word, and what they sound as.
_OPENINGS = tuple((re.compile("^" + a), b) for a, b in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W")))


def metaphone_key(text: str) -> str:
    """The sounds of each word, joined by blanks; empty without letters."""
    keys = []
    for part in text.upper().split():
        word = re.sub("[^A-Z]", "", part)
        for pattern, put in _OPENINGS:
            changed = pattern.sub(put, word)
            if changed != word:
                word = changed
                break
        out, at = [], 0
        while at < len(word):
            for pattern, code in _RULES:
                if m := pattern.match(word, at):
                    out.append(m.group(0) if code is None else code)
                    at = m.end()
                    break
        keys.append("".join(out))
    return " ".join(k for k in keys if k)


@F.pandas_udf(StringType())
def metaphone(text: pd.Series) -> pd.Series:
    return text.fillna("").map(metaphone_key)


def sounds_like(a: Column, b: Column) -> Column:
    """Whether two names have the same sounds; names without letters are like none."""
    sound = metaphone(a)
    return (sound != "") & (sound == metaphone(b))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, sensitive to the order of its arguments."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
