"""Retrieve, judge and verify by criterion: the sentences of each document for each criterion, and what a judgment is worth.

All that a document's sentences are compared by is its own, so documents are dealt over tasks and never shuffled; the
criteria, a protocol's, are sent to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..functions.text import search_tokens, sentences
from .ranking import B, EPSILON, K1
from .screening import span_penalty, verify_spans

#: Documents whose terms are counted together, sentences and criteria that meet in one product.
DOCUMENTS, SENTENCES, CRITERIA = 64, 1024, 256
FOUND = "array<struct<criterion_id:{id},sentences:array<struct<position:int,score:double>>>>"


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest values of each column, of equal ones the first."""
    values, out = values.copy(), []
    for _ in range(min(k, len(values))):
        out.append(values.argmax(axis=0))
        np.put_along_axis(values, out[-1][None], -np.inf, axis=0)
    return np.stack(out)


def _sentence_weights(flat: pa.Array, sentence: np.ndarray, doc: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """sentence, place in the vocabulary, count and BM25 part of each of its terms that a sentence has, by sentence; and the sentences' norms.

    ``flat`` has all tokens with their ``sentence``, ``doc`` the document of each sentence; statistics are a document's own.
    """
    coded = flat.dictionary_encode()
    codes, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    key, tf = np.unique(sentence * size + codes, return_counts=True)
    at, code, n_docs = key // size, key % size, int(doc[-1]) + 1
    dl, norm = np.bincount(at, tf, len(doc)), np.sqrt(np.bincount(at, tf * tf, len(doc)))
    n = np.bincount(doc, minlength=n_docs)
    average = np.bincount(doc, dl, n_docs) / np.maximum(n, 1)
    held, inverse, df = np.unique(doc[at] * size + code, return_inverse=True, return_counts=True)
    of = held // size
    idf = np.log(n[of] - df + 0.5) - np.log(df + 0.5)
    mean = np.bincount(of, idf, n_docs) / np.maximum(np.bincount(of, minlength=n_docs), 1)
    idf = np.where(idf < 0, EPSILON * mean[of], idf)[inverse]
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary.cast(coded.dictionary.type)), -1).to_numpy(zero_copy_only=False)[code]
    asked = place >= 0
    at, tf, idf = at[asked], tf[asked].astype(float), idf[asked]
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / average[doc[at]]))
    return at, place[asked], tf, part, norm


def _nearest(n: int, terms: tuple[np.ndarray, ...], norm: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Positions and cosines of the k nearest of n sentences and of the k best by BM25 above 0 (else -1), for each criterion."""
    at, place, tf, part = terms
    own, column = np.unique(place, return_inverse=True)
    asked, q_norm, sides = times[own], np.sqrt((times * times).sum(axis=0)), (None, None)
    for start in range(0, n, SENTENCES):
        size, (a, b) = min(SENTENCES, n - start), np.searchsorted(at, (start, start + SENTENCES))
        counts, parts = np.zeros((2, size, len(own)))
        counts[at[a:b] - start, column[a:b]], parts[at[a:b] - start, column[a:b]] = tf[a:b], part[a:b]
        dot, lexical = counts @ asked, np.round(parts @ (asked > 0), 12)
        length = norm[start:start + size, None] * q_norm
        cosine = np.round(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), 12)
        position, new = np.broadcast_to(np.arange(start, start + size)[:, None], dot.shape), []
        for by, held in zip((cosine, lexical), sides, strict=True):
            rows = (by, position, cosine)
            if held is not None:  # the best of the sentences before
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            pick = _best(rows[0], k)
            new.append(tuple(np.take_along_axis(x, pick, axis=0) for x in rows))
        sides = tuple(new)
    (_, near, cosine), (lexical, best, also) = sides
    return near, cosine, np.where(lexical > 0, best, -1), also


def _finder(criteria: DataFrame, k: int, terms: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a document's search tokens by sentence in ``terms`` to batches with ``found`` in its place."""
    asked = criteria.select("criterion_id", F.explode(search_tokens(F.col("criterion_text"))).alias("term")).groupBy("criterion_id", "term").agg(F.count("*").alias("times"))
    # a protocol's criteria: few
    rows, names = asked.orderBy("criterion_id", "term").collect(), [r[0] for r in criteria.select("criterion_id").distinct().orderBy("criterion_id").collect()]
    kind, blocks = criteria.select("criterion_id").limit(0).toArrow().schema.field(0).type, []
    for i in range(0, len(names), CRITERIA):
        own = {c: j for j, c in enumerate(names[i:i + CRITERIA])}
        some = [r for r in rows if r["criterion_id"] in own]
        vocabulary = sorted({r["term"] for r in some})
        places, times = {t: j for j, t in enumerate(vocabulary)}, np.zeros((len(vocabulary), len(own)))
        for r in some:
            times[places[r["term"]], own[r["criterion_id"]]] = r["times"]
        blocks.append((list(own), vocabulary, times))
    shared = criteria.sparkSession.sparkContext.broadcast(blocks)

    def of_documents(batch: pa.RecordBatch, blocks) -> pa.RecordBatch:
        lists = batch.column(terms)
        lists = lists.filter(pc.greater(pc.list_value_length(lists), 0))
        batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(terms)), 0), False))
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        tokens, doc = lists.flatten(), np.repeat(np.arange(len(n)), n)
        sentence, firsts = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False)), np.r_[0, np.cumsum(n)]
        flat, names, per_name, positions, scores = tokens.flatten(), [], [], [], []
        weighed = [_sentence_weights(flat, sentence, doc, vocabulary) for _, vocabulary, _ in blocks] if len(n) else []
        for i, size in enumerate(n):
            for (own, _, times), (*some, norm) in zip(blocks, weighed, strict=True):
                a, b = np.searchsorted(some[0], firsts[i:i + 2])
                near, cosine, best, also = _nearest(int(size), (some[0][a:b] - firsts[i], *(x[a:b] for x in some[1:])), norm[firsts[i]:firsts[i + 1]], times, k)
                best = np.where((best[:, None] == near[None]).any(axis=1), -1, best)
                both = np.concatenate((near, best)).T
                names += own
                per_name.append((both >= 0).sum(axis=1))
                positions.append(both[both >= 0])
                scores.append(np.concatenate((cosine, also)).T[both >= 0])
        flat_of = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        inner = pa.StructArray.from_arrays([pa.array(flat_of(positions, "int32")), pa.array(flat_of(scores, "float64"))], ["position", "score"])
        inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flat_of(per_name, "int64"))].astype("int32")), inner)
        outer = pa.StructArray.from_arrays([pa.array(names, kind), inner], ["criterion_id", "sentences"])
        found = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="int32") * sum(len(own) for own, _, _ in blocks)), outer)
        rest = [c for c in batch.schema.names if c != terms]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], [*rest, "found"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(own, pa.array(vocabulary, pa.string()), times) for own, vocabulary, times in shared.value]
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                yield of_documents(batch.slice(start, DOCUMENTS), blocks)

    return of_batches


def with_found(docs: DataFrame, criteria: DataFrame, keep: list[str], k: int = 5, text: str = "text") -> DataFrame:
    """Columns ``keep`` of the documents that have a sentence, and found: for each criterion its k nearest sentences and its k best ones by BM25.

    The first are by cosine of the term counts, those of 0 in document order; the second must score above 0, with
    the statistics of the document's own sentences, each term of the criterion counting once. The score is the
    cosine. ``criteria`` (criterion_id, criterion_text) are a protocol's: few.
    """
    rows = docs.select(*keep, F.transform(sentences(text), search_tokens).alias("found"))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", found {FOUND.format(id=dict(criteria.dtypes)['criterion_id'])}"
    return rows.mapInArrow(_finder(criteria, k, "found"), schema)


def retrieve(docs: DataFrame, criteria: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, criterion_id, position, score: a row for each sentence of ``with_found``."""
    found = with_found(docs, criteria, [key], k, text).select(key, F.explode("found").alias("f"))
    return found.select(key, "f.criterion_id", F.explode("f.sentences").alias("x")).select(key, "criterion_id", "x.position", "x.score")


def judged(replies: DataFrame, span: str = "span", text: str = "text", cap: float = 0.30) -> DataFrame:
    """p, verified, hallucinated for each reply (satisfies, confidence, a span of evidence and the text it should be in).

    A "yes" is worth its confidence, anything else the rest of it, at most ``cap``; a span that the text
    doesn't have costs the most of that. A missing confidence is 0.5.
    """
    sure = clamp(F.coalesce("confidence", F.lit(0.5)))
    p = F.when(F.lower(F.col("satisfies").cast("string")) == "true", sure).otherwise(F.least(1 - sure, F.lit(cap)))
    rows = verify_spans(replies, span, text)
    given = F.trim(F.coalesce(span, F.lit(""))) != ""
    return rows.withColumns({"p": clamp(span_penalty(p, F.col(span), F.col("verified"))), "hallucinated": given & ~F.coalesce("verified", F.lit(False))})
