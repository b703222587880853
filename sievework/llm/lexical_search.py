"""Ranked lexical search: an inverted index in shards of documents, searched by MaxScore.

``build_index`` cuts the documents of each partition into shards of bounded size, without a shuffle, and
writes one row for each term of a shard: the numbers of the shard's documents that hold it, ascending, and how
often. One row without a term holds the shard's doc_ids and lengths. ``search`` joins the index with the
terms of the queries (broadcast only below BROADCAST_TERMS terms) and brings the lists of a shard and a
block of queries together, a group as bounded as its shard. There each query is answered document range by
document range: lists whose upper bounds together stay below the score needed are non-essential and are only
probed for documents that the essential lists found and that can still qualify.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Weights,
lengths and scores are the integers that ``op11`` is defined by (``weight``, ``damp``, ``impact``).

Defined cases: a null or empty text has no terms, so such documents are never found and such queries find
nothing; rows whose identifier is null are left out; documents that share a doc_id are ranked each on its
own; queries that share an item_id are one query with the terms of all; equal scores rank by ascending doc_id;
texts of any length are read whole; an empty table of documents or queries gives an empty result; other
columns, whatever their names, are never read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, texts
from .shingles import _pieces, parts, release

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text after which a shard is closed; a longer text is a shard of its own at most.
SHARD_BYTES = 8 << 20
#: Queries that are answered together in a shard, documents of a range there, and query terms that may be broadcast.
BLOCK, RANGE, BROADCAST_TERMS = 256, 512, 50_000
_INDEX = "shard long, term string, holders long, total long, docs binary, counts binary"


def weight(documents: int, holders: int) -> int:
    """Of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def damp(length: int, documents: int, total: int) -> int:
    """What a document's length in terms adds to an occurrence's share; Python integers can't overflow."""
    return 8 * (100 - 75 + 75 * length * documents // total)


def impact(counts: np.ndarray, damps: np.ndarray) -> np.ndarray:
    """What a term adds to documents, in units of its weight."""
    return 1_000_000_000 * counts // (1000 * counts + damps)


class Shard:
    """The documents of a shard while it is filled."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.terms: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.docs: list[int] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc: int, raw: bytes) -> None:
        """A document; its words get the numbers of the shard's vocabulary."""
        self.docs.append(doc)
        self.ids.append(np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(self.terms.__getitem__, TERM.findall(p)), np.int64) for p in _pieces(raw.lower()))]))
        self.size += len(raw) + 64

    def rows(self) -> pa.RecordBatch:
        """The shard's part of the index."""
        order = np.argsort(np.array(self.docs, np.int64), kind="stable")
        lengths = np.array([len(i) for i in self.ids], np.int64)[order]
        n = len(order)
        key = np.concatenate([self.ids[i] * n + at for at, i in enumerate(order)])
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(key)]).astype("<i4")
        term, doc = np.divmod(key[first], n)
        holders = np.bincount(term, minlength=len(self.terms))
        totals = np.bincount(term, weights=counts, minlength=len(self.terms)).astype(np.int64)
        ends = np.r_[0, np.cumsum(holders)].astype("<i4") * 4
        lists = [pa.Array.from_buffers(pa.binary(), len(self.terms), [None, pa.py_buffer(ends), pa.py_buffer(v.astype("<i4").tobytes())]) for v in (doc, counts)]
        whole = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(self.docs, "<i8")[order], lengths.astype("<i8"))]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(self.terms) + 1, self.number)),
            pa.array([None, *(t.decode() for t in self.terms)], pa.string()),
            pa.array(np.r_[np.count_nonzero(lengths), holders].astype(np.int64)),
            pa.array(np.r_[lengths.sum(), totals].astype(np.int64)),
            *[pa.concat_arrays([a, b]) for a, b in zip(whole, lists, strict=True)],
        ], ["shard", "term", "holders", "total", "docs", "counts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> DataFrame:
    """The index, written to ``path`` (default: a fresh folder of the shared one) and read again."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        numbers = itertools.count((task.partitionId() if task else 0) << 32)
        open_ = Shard(next(numbers))
        for batch in batches:
            for ids, bodies in parts(batch):
                for doc, text in zip(ids, bodies, strict=True):
                    if open_.docs and open_.size + len(text) > shard_bytes:
                        yield open_.rows()
                        open_ = Shard(next(numbers))
                    open_.add(doc, text.encode())
        if open_.docs:
            yield open_.rows()
        release()

    return staged(texts(docs, id_col, text_col).mapInArrow(shards, _INDEX), "search-index", path)


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of the queries, by the same rule as the index."""

    def cut(batches):
        for batch in batches:
            for ids, bodies in parts(batch):
                for item, text in zip(ids, bodies, strict=True):
                    for piece in _pieces(text.encode().lower()):
                        found = [t.decode() for t in TERM.findall(piece)]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.string())], ["item_id", "term"])

    return texts(items, id_col, text_col).mapInArrow(cut, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


class List:
    """A term's documents in a shard, what the term adds to each in units of its weight, and where the ranges begin."""

    def __init__(self, numbers: np.ndarray, impacts: np.ndarray, edges: np.ndarray):
        self.numbers, self.impacts, self.bound = numbers, impacts, int(impacts.max(initial=0))
        self.cut = np.searchsorted(numbers, edges).tolist()


def max_score(lists: list[tuple[List, int]], documents: int, k: int, span: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents with a score above 0, best first, equal ones by number.

    ``lists`` has each list with its factor (weight times repeats). Ranges of ``span`` documents come in
    ascending order, so a later document must beat the k-th best so far.
    """
    lists = sorted((x for x in lists if x[1] * x[0].bound > 0), key=lambda x: x[1] * x[0].bound)
    bounds = np.cumsum([f * p.bound for p, f in lists], dtype=np.int64)
    numbers, scores, needed = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for r, low in enumerate(range(0, documents, span)):
        split = int(np.searchsorted(bounds, needed))  # the lists before it can't reach the score needed together
        if split == len(lists):
            break
        sums = np.zeros(min(span, documents - low), np.int64)
        for p, f in lists[split:]:
            at = slice(p.cut[r], p.cut[r + 1])
            sums[p.numbers[at] - low] += f * p.impacts[at]
        found = np.flatnonzero(sums)
        part = sums[found]
        for j in range(split - 1, -1, -1):
            able = part + bounds[j] >= needed
            found, part = found[able], part[able]
            if not len(found):
                break
            p, f = lists[j]
            own = p.numbers[p.cut[r]:p.cut[r + 1]] - low
            if len(own):
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                part = part + np.where(own[at] == found, f * p.impacts[p.cut[r] + at], 0)
        able = part >= needed
        numbers, scores = np.r_[numbers, found[able] + low], np.r_[scores, part[able]]
        best = np.lexsort((numbers, -scores))[:k]
        numbers, scores = numbers[best], scores[best]
        if len(scores) == k:
            needed = int(scores[-1]) + 1
    return numbers, scores


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for each query.

    Documents, terms and holders of a term are counted over the whole index.
    """
    spark = index.sparkSession
    documents, total = index.where("term is null").agg(F.sum("holders"), F.sum("total")).first()
    asked = staged(query_terms(items, id_col, text_col), "search-terms")
    n_terms, n_items = asked.agg(F.countDistinct("term"), F.countDistinct("item_id")).first()
    if not total or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_terms <= BROADCAST_TERMS else df

    n_blocks = -(-n_items // block)
    holders = index.where("term is not null").select("term", "holders").join(sized(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("holders").alias("all_holders"))
    wanted = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")).groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    wanted = staged(wanted.join(sized(holders), "term"), "search-weights")
    lists = index.where("term is not null").join(sized(wanted), "term").select("shard", "block", "all_holders", "items", "docs", "counts")
    ids = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(None).cast("long").alias("all_holders"), F.lit(None).cast(lists.schema["items"].dataType).alias("items"), "docs", "counts")

    def answer(group: pa.Table) -> pa.Table:
        rows = group.select(["all_holders", "items", "docs", "counts"]).to_pydict()
        head = rows["all_holders"].index(None)
        doc_ids = np.frombuffer(rows["docs"][head], "<i8")
        damps = np.array([damp(n, documents, total) for n in np.frombuffer(rows["counts"][head], "<i8").tolist()], np.int64)
        edges = np.arange(0, len(doc_ids) + span, span)
        queries = defaultdict(list)
        for held, users, docs, counts in zip(*rows.values(), strict=True):
            if held is None:
                continue
            numbers = np.frombuffer(docs, "<i4").astype(np.int64)
            own = List(numbers, impact(np.frombuffer(counts, "<i4").astype(np.int64), damps[numbers]), edges)
            w = weight(documents, held)
            for user in users:
                queries[user["item_id"]].append((own, w * user["times"]))
        out = [(item, *max_score(own, len(doc_ids), k, span)) for item, own in sorted(queries.items())]
        return pa.table({
            "item_id": pa.array(np.repeat([i for i, _, _ in out], [len(n) for _, n, _ in out]).astype(np.int64)),
            "doc_id": pa.array(np.concatenate([doc_ids[:0], *(doc_ids[n] for _, n, _ in out)])),
            "score": pa.array(np.concatenate([doc_ids[:0], *(s for _, _, s in out)])),
        })

    found = lists.unionByName(ids).groupBy("shard", "block").applyInArrow(answer, "item_id long, doc_id long, score long")
    # the limit of a rank is taken in each task before the shuffle too
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query, over an index of all documents."""
    return search(build_index(docs), items, k)
