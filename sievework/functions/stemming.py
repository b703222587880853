"""Porter's suffix stripping with the usual later extensions, for English words in lower case.

A word is seen as consonants and vowels; its measure is the number of vowel-consonant sequences. The steps are
tables of (suffix, replacement, condition on the rest); of a table the first suffix that fits decides, whether or
not its condition holds.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words that are not stemmed by rule, and the rules of steps 2 to 4.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """v for vowels, c for consonants; a y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = _kinds(word)
    return kinds == "vc" or kinds[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _first(word: str, rules, holds: Callable[[str, str], bool]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            rest = word[:len(word) - len(suffix)]
            return rest + new if holds(rest, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return _first(word, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), lambda rest, suffix: True)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else ""
    if "v" not in _kinds(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short(rest) else rest


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _first(word, STEP_2, lambda rest, suffix: _measure(rest) > 0)


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _kinds(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _derived(word)
    word = _first(word, STEP_3, lambda rest, suffix: _measure(rest) > 0)
    word = _first(word, [(s, "") for s in STEP_4], lambda rest, suffix: _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))))
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """term, stem of the distinct terms: a word is stemmed once, however many documents hold it."""
    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(functools.lru_cache(100_000)(stem))

    return vocabulary.select(term).where(F.col(term).isNotNull()).distinct().withColumn("stem", stemmed(term))


#: Documents whose words are counted at once.
SLICE = 1000


def stem_counts(docs: DataFrame, words: Column, key: str) -> DataFrame:
    """key, dl, stems, tf: each document's number of words, its distinct stems and how often it has each, without a shuffle.

    A batch's distinct words are stemmed once, and known ones are remembered.
    """
    rows = docs.select(key, words.alias("words"))

    def counted(batches):
        known = functools.lru_cache(100_000)(stem)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            names, at = np.unique(np.array([known(w) for w in coded.dictionary.to_pylist()], object), return_inverse=True)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths())
            pairs, tf = np.unique(row * max(1, len(names)) + at[coded.indices], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(lists) + 1) * max(1, len(names))).astype(np.int32)
            stems = pa.DictionaryArray.from_arrays(pa.array(pairs % max(1, len(names))), pa.array(names, pa.string())).cast(pa.string())
            columns = [batch.column(0), lists.value_lengths(), pa.ListArray.from_arrays(ends, stems), pa.ListArray.from_arrays(ends, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "dl", "stems", "tf"])

    return rows.mapInArrow(counted, StructType([rows.schema[0], *StructType.fromDDL("dl int, stems array<string>, tf array<bigint>").fields]))


#: Words that the tokenizer of the stemmed ranking cuts in two.
CONTRACTIONS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}


def plain_words(c, stop: list[str]) -> Column:
    """Words in lower case between white space and ASCII punctuation, without the stop words."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[!-/:-@\[-`{-~]+", " ")
    text = F.regexp_replace(text, r"\b(" + "|".join(rf"{two.split()[0]}(?={two.split()[1]}\b)" for two in CONTRACTIONS.values()) + ")", "$1 ")
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.isin(stop))
