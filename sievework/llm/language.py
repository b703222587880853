"""Language identification by rank-order profiles (out-of-place distance).

A profile is the PROFILE most frequent letter n-grams (1 to 3 letters, words in lower case with a blank on
either side) with their ranks. A document's distance to a language is the sum, over its own profile, of the
differences between the two ranks, PROFILE for an n-gram that the language's profile lacks. The nearest
language is predicted.

Profiles are learned from at most about SAMPLE documents of each of at most LANGUAGES languages (the most
frequent ones), chosen by a hash of doc_id at a rate of each language's own, so that a frequent language
costs no more than others and a rare one is learned from all its documents. In a profile a document counts by
its length up to LONG n-grams. Every document is predicted from its whole text.

Defined cases: texts that are null or have no letter are predicted ``und`` with score 0, and so are all where
nothing could be learned; n-grams of equal frequency share the mean of their ranks, and the last ones of a profile
are chosen by code points; languages at equal distance: the smaller name; rows whose identifier is null are left
out; rows that share a doc_id are predicted each from its own text; texts of any length are read whole; an
empty table gives an empty result; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, texts
from .shingles import blocks

PROFILE, SAMPLE, LANGUAGES, LONG = 400, 2_000, 1_000, 20_000
UNKNOWN = "und"
#: Characters whose n-grams are counted at once, and a document's share of a profile's counts in whole numbers.
PIECE, UNIT = 1 << 20, 1_000_000
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank where it isn't a letter."""
    out = np.full(0x110000, _BLANK, np.int64)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """The words of a text as code points in lower case, a blank before, between and after them."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    points = np.r_[_BLANK, points, _BLANK]
    return points[np.r_[True, (points[1:] != _BLANK) | (points[:-1] != _BLANK)]]


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ``letters``, ascending, and how often each occurs; n-grams lie within a word and its blanks."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(points), PIECE):
        c = points[max(0, at - 2):at + PIECE]
        old = min(at, 2)  # of the piece before; n-grams that end there are counted
        two, three = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        found = np.concatenate([c[old:][c[old:] != _BLANK], two[max(0, old - 1):], three[max(0, old - 2):][c[1:-1][max(0, old - 2):] != _BLANK]])
        found.sort()
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        own, n = found[first], np.diff(np.r_[first, len(found)])
        if not len(keys):
            keys, counts = own, n
        else:
            keys, inverse = np.unique(np.r_[keys, own], return_inverse=True)
            counts = np.bincount(inverse, weights=np.r_[counts, n], minlength=len(keys)).astype(np.int64)
    return keys, counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks from 0 of counts that descend; equal counts share the mean of their ranks."""
    first = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]]) if len(counts) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(counts)])
    return np.repeat(first + (size - 1) / 2, size)


def profile(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their ranks."""
    if len(counts) > 4 * most:  # only those that can be among them are sorted
        able = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[able], counts[able]
    order = np.lexsort((keys, -counts))[:most]
    return keys[order], ranks(counts[order])


class Model:
    """The profiles of all languages: each n-gram of any of them has a row of ranks."""

    def __init__(self, profiles: dict[str, tuple[np.ndarray, np.ndarray]], most: int = PROFILE):
        self.languages, self.most = sorted(profiles), most
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in profiles.values())]))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), np.nan)  # the last row: no language has it
        for i, name in enumerate(self.languages):
            keys, own = profiles[name]
            self.ranks[np.searchsorted(self.keys, keys), i] = own

    def distances(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Out-of-place distances of a document's profile to every language."""
        at = np.searchsorted(self.keys, keys)
        at = np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys), at, len(self.keys))
        return np.nan_to_num(np.abs(self.ranks[at] - own[:, None]), nan=self.most).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score of a text: by how much of its distance the second-nearest language is farther."""
        points = letters(text)
        if len(points) == 1 or not self.languages:
            return UNKNOWN, 0.0
        keys, own = profile(*ngrams(points), self.most)
        d = self.distances(keys, own)
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.languages[0], 1.0 - float(d[0]) / (self.most * len(keys))
        second = float(np.partition(d, 1)[1])
        return self.languages[best], (second - float(d[best])) / second if second else 0.0


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, most: int = PROFILE, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Profiles from the rows that are not held out and have a language."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    reach = {r["lang"]: r["count"] for r in sizes.collect()}  # one row a language, at most LANGUAGES
    if not reach:
        return Model({}, most)
    # a share of all 64-bit hashes, smaller for frequent languages
    rates = docs.sparkSession.createDataFrame([(name, min(sample * 2 ** 64 // n - 2 ** 63, 2 ** 63 - 1)) for name, n in reach.items()], "lang string, reach long")
    chosen = known.join(F.broadcast(rates), "lang").where(F.xxhash64("doc_id") <= F.col("reach")).select("lang", "text")

    def count(batches) -> Iterator[pa.RecordBatch]:
        for langs, bodies in blocks(batches):
            for lang, text in zip(langs, bodies, strict=True):
                keys, n = ngrams(letters(text))
                shares = n * UNIT // max(int(n.sum()), LONG)  # a document's length counts up to LONG
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(shares)], ["lang", "gram", "n"])

    totals = staged(chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    top = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= most).orderBy("lang", "place")
    found: dict[str, list[list[int]]] = {}
    for r in top.collect():  # PROFILE rows a language
        own = found.setdefault(r["lang"], [[], []])
        own[0].append(r["gram"])
        own[1].append(r["n"])
    return Model({name: (np.array(k, np.int64), ranks(np.array(n, np.int64))) for name, (k, n) in found.items()}, most)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANGUAGES profiles of PROFILE n-grams at most

    def predict(batches):
        own = shared.value
        for ids, bodies in blocks(batches):
            found = [own.predict(text) for text in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return identify(docs, train(docs))
