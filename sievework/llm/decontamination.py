"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set, each partition reaching from above half its
largest size (a power of two, from 1) to that. For each partition, documents are cut
into windows of the partition's largest size, so that an item and a window that holds it have like
sizes and containment turns into a high Jaccard similarity, however long the document is. An item is a
candidate for a document if one of its MinHash values is a window's; candidates are verified by the
exact share of the item's shingles that the whole document holds.

Of an item's smallest hash, with a share of at least 0.8 of its shingles in the document, a window has
it with probability 0.8, and it is the window's smallest too with probability 1/3 at least, as the
window's other shingles are fewer than twice the item's; so 64 hash functions miss an item of any size
with a probability of about 2e-9. Items of one shingle are never missed: their windows are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged, texts
from .shingles import blocks, shingles

HASHES = 64
#: Items, and shingles of items, that are searched for in one pass over the documents.
ITEMS, ITEM_SHINGLES = 16_384, 1 << 21
_SALTS = np.array([pow(0xD1342543DE82EF95, i, 1 << 64) | 1 for i in range(1, HASHES + 1)], np.uint64)


class ItemIndex:
    """MinHash values of a block of items, by size partition and hash function."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(b, "<u8") for _, b in items]
        size = np.array([len(s) for s in self.sets], np.int64)
        part = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.partitions = []
        for width in np.unique(part[size > 0]).tolist():
            members = np.flatnonzero((part == width) & (size > 0))
            values = np.array([[(self.sets[m] * salt).min() for m in members] for salt in _SALTS], np.uint64)
            order = np.argsort(values, axis=1, kind="stable")
            maps = np.zeros((HASHES, 1 << 16), bool)
            maps[np.arange(HASHES)[:, None], (values >> np.uint64(48)).astype(np.int64)] = True
            self.partitions.append((int(width), np.take_along_axis(values, order, 1), members[order], maps))

    def candidates(self, number: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs with a common MinHash value; number and h are the texts' shingles in order."""
        found = [np.zeros(0, np.int64)]
        if not len(h) or not self.partitions:
            return np.zeros((0, 2), np.int64)
        place = np.arange(len(h)) - np.searchsorted(number, number, "left")
        for j, salt in enumerate(_SALTS):
            low, starts = h * salt, None
            for width, values, members, maps in self.partitions:
                if width == 1 and j:  # the first hash has found all items of one shingle
                    continue
                # windows of a wider partition are made of the narrower one's
                at = np.flatnonzero(place % width == 0) if starts is None else np.flatnonzero(place[starts] % width == 0)
                low = np.minimum.reduceat(low, at)
                starts = at if starts is None else starts[at]
                some = np.flatnonzero(maps[j][(low >> np.uint64(48)).astype(np.int64)])
                if len(some):
                    a, b = np.searchsorted(values[j], low[some], "left"), np.searchsorted(values[j], low[some], "right")
                    hit = np.repeat(np.arange(len(some)), b - a)
                    item = members[j][np.repeat(a, b - a) + np.arange(len(hit)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
                    found.append(np.unique(number[starts[some[hit]]] * len(self.ids) + item))
        return np.stack(np.divmod(np.unique(np.concatenate(found)), len(self.ids)), axis=1)

    def verified(self, number: np.ndarray, h: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of the candidates that reach the containment."""
        out, at, own = [], -1, None
        for text, item in self.candidates(number, h).tolist():
            if text != at:
                at, own = text, np.unique(h[np.searchsorted(number, text, "left"):np.searchsorted(number, text, "right")])
            shared = int((own[np.minimum(np.searchsorted(own, self.sets[item]), len(own) - 1)] == self.sets[item]).sum())
            if 100 * shared >= percent * len(self.sets[item]):
                out.append((text, item, shared))
        return out


def _item_sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item_id, text in blocks(batches):
            number, h = shingles([t.encode() for t in text], k, short=False)
            own = [np.unique(h[number == i]) for i in range(len(text))]
            yield pa.RecordBatch.from_pydict({"item_id": item_id, "n": [len(s) for s in own], "body": [s.astype("<u8").tobytes() for s in own]})

    return sets


def _indexes(items: DataFrame, k: int) -> Iterator:
    """The items' indexes, block by block, as broadcast variables."""
    spark = items.sparkSession
    sets = staged(texts(items, "item_id").withColumnRenamed("doc_id", "item_id").mapInArrow(_item_sets(k), "item_id long, n long, body binary").where("n > 0"), "leak-items")
    n, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS), -(-total // ITEM_SHINGLES))
    for number in range(passes):
        # a block of the query set: at most about ITEMS items and ITEM_SHINGLES shingles, whatever the number of documents
        block = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id").collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r["item_id"], bytes(r["body"])) for r in block]))


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment for each document and test item in it.

    ``docs`` has doc_id, text; ``items`` item_id, text. An item is in a document if the document holds
    at least ``percent`` of the item's distinct shingles of k words (A-Z in lower case). Null and
    empty texts, and texts of fewer than k words, hold nothing and are in nothing; texts of any length
    are searched whole; rows without an identifier are left out; repeated documents and items (ties) are
    reported each; empty tables give an empty result; extra columns are ignored. The documents are read
    once for each block of ITEMS items.
    """
    rows, out = texts(docs), None
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    for index in _indexes(items, k):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for doc_id, text in blocks(batches):
                at, h = shingles([t.encode() for t in text], k, short=False)
                found = own.verified(at, h, percent)
                if found:
                    size = [len(own.sets[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc_id[t] for t, _, _ in found], "item_id": [own.ids[i] for _, i, _ in found], "shared": [s for *_, s in found], "item_shingles": size, "containment": [s / n for (*_, s), n in zip(found, size, strict=True)]})

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold none of the items; cases as for leaks()."""
    out = docs
    for index in _indexes(items, k):

        def chosen(text: list[str], index=index) -> list[bool]:
            at, h = shingles([t.encode() for t in text], k, short=False)
            found = {t for t, _, _ in index.value.verified(at, h, percent)}
            return [t not in found for t in range(len(text))]

        out = only(out, {"text_": F.coalesce(F.col("text").cast("string"), F.lit(""))}, chosen)
    return out
