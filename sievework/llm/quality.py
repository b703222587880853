"""Quality classifier by co-training of two views.

One classifier sees the text's content only (its bytes, its words by hash, and a few counts of words and lines),
the other the page's metadata only (language, source, stated length). Both start from labelled rows;
in each round each view labels the documents of a pool of which it is surest and hands them to the
other. Both are then calibrated on labelled rows kept apart, combined there, and applied to all rows.

Fitting uses bounded samples, chosen by a hash of doc_id: about SAMPLE labelled and POOL unlabelled
rows. Every document is scored from its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, only, small_batches, staged
from .shingles import PIECE, _grouped, _pieces, blocks, word_hashes

SAMPLE, POOL = 12_000, 6_000
ROUNDS, SURE, STEP = 4, 0.97, 300
#: Share of good labelled rows, kept apart, that the threshold must keep, and the highest threshold:
#: a document goes only if it is junk by three to one.
KEEP, HIGHEST = 0.997, 0.25
_BUCKETS = 64
#: Buckets of the text's words, and all features of a text.
_WORDS = 128
_TEXT = 256 + _WORDS + 6


def text_features(raws: list[bytes]) -> np.ndarray:
    """Root frequencies of bytes and of hashed words, and logarithms of length, word length, line length, shares of distinct words and lines."""
    out = np.zeros((len(raws), _TEXT))
    for group in _grouped(raws):
        if len(group) == 1 and len(raws[group[0]]) > PIECE:
            raw = raws[group[0]]
            out[group[0]] = _features(np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[None], [raw])[0]
            continue
        own = [raws[i] for i in group]
        size = np.array([len(r) for r in own])
        data = np.frombuffer(b"".join(own), np.uint8)
        number = np.repeat(np.arange(len(own)), size)
        out[group] = _features(np.bincount(number * 256 + data, minlength=256 * len(own)).reshape(-1, 256), own)
    return out


def _features(histogram: np.ndarray, raws: list[bytes]) -> np.ndarray:
    size = np.maximum(1, histogram.sum(axis=1, keepdims=True))
    extra, hashed = np.zeros((len(raws), 6)), np.zeros((len(raws), _WORDS))
    for i, raw in enumerate(raws):
        words = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(p)[1] for p in _pieces(raw))])
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n = len(words) or 1
        hashed[i] = np.bincount((words >> np.uint64(40)).astype(np.int64) % _WORDS, minlength=_WORDS) / n
        extra[i] = (np.log1p(len(raw)) / 10, np.log1p(len(raw) / n) / 3, len(np.unique(words)) / n if len(words) else 0.5, np.log1p(len(raw) / max(1, len(lines))) / 8, len(set(lines)) / max(1, len(lines)), float(not raw.strip()))
    return np.hstack((np.sqrt(histogram / size) * 3, np.sqrt(hashed) * 3, extra))


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Language and source by hash, null being a value of its own, and the stated length."""
    out = np.zeros((len(lang), 2 * _BUCKETS + 2))
    at = np.arange(len(lang))
    for start, values in ((0, lang), (_BUCKETS, source)):
        out[at, start + np.array([zlib.crc32(f"v{v}".encode() if v is not None else b"") % _BUCKETS for v in values], np.int64)] = 1
    out[:, -2] = [np.log1p(max(0, n)) / 10 if n is not None else 0 for n in n_chars]
    out[:, -1] = [float(n is None) for n in n_chars]
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one of a constant, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    damp = np.full(len(w), ridge)
    damp[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(damp), x.T @ (weight * (p - y)) + damp * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(views: list[np.ndarray], label: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS) -> dict:
    """The model, from both views of sampled rows. label: 1, 0 or -1 (none); apart: labelled rows for calibration."""
    fit = (label >= 0) & ~apart
    if len(np.unique(label[fit])) < 2:  # nothing to learn from: everything is kept
        return {"weights": [np.zeros(v.shape[1] + 1) for v in views], "scale": [np.array([1.0, 0.0])] * 2, "mix": np.array([0.0, 0.0, 30.0]), "threshold": 0.0}
    known = [np.where(fit, label, -1).astype(float) for _ in views]
    weights = [None, None]
    for r in range(rounds + 1):
        for v, x in enumerate(views):
            use = known[v] >= 0
            weights[v] = logistic(x[use], known[v][use], np.where(fit[use], 1.0, 0.3))
        if r == rounds:
            break
        for v, x in enumerate(views):
            p, other = sigmoid(logits(x, weights[v])), known[1 - v]
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                new = np.flatnonzero((label < 0) & (other < 0) & (sure >= SURE))
                other[new[np.argsort(-sure[new], kind="stable")[:STEP]]] = value
    test = apart & (label >= 0)
    if len(np.unique(label[test])) < 2:
        test = label >= 0
    y, one = label[test].astype(float), np.ones(int(test.sum()))
    z = [logits(x[test], w) for x, w in zip(views, weights, strict=True)]
    scale = [logistic(a[:, None], y, one, 1e-3) for a in z]
    calibrated = np.stack([logits(a[:, None], s) for a, s in zip(z, scale, strict=True)], axis=1)
    mix = logistic(calibrated, y, one, 1e-2)
    score = sigmoid(logits(calibrated, mix))
    good, bad = np.sort(score[y == 1]), score[y == 0]
    lowest = good[min(len(good) - 1, int((1 - KEEP) * len(good)))]
    # between the junk and the good rows where they are apart, else where KEEP of the good rows stay
    junk = bad[bad < lowest].max() if (bad < lowest).any() else 0.0
    return {"weights": weights, "scale": scale, "mix": mix, "threshold": float(min(HIGHEST, (junk + lowest) / 2))}


def apply_model(model: dict, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated scores of both views, and the combined one."""
    z = np.stack([logits(logits(x, w)[:, None], s) for x, w, s in zip(views, model["weights"], model["scale"], strict=True)], axis=1)
    return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(logits(z, model["mix"]))


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")).toDF(*_COLUMNS).where("doc_id is not null")


def _views(text: list[str], lang: list, source: list, n_chars: list) -> list[np.ndarray]:
    return [text_features([t.encode() for t in text]), meta_features(lang, source, n_chars)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> dict:
    """Fit on about ``sample`` labelled and ``pool`` unlabelled documents; labels: doc_id, quality (1 good, 0 junk)."""
    rows = _rows(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_known, n_docs = known.count(), rows.count()
    some = known.where(drawn("doc_id", sample / max(1, n_known))).select("doc_id", "quality")
    # at most about ``sample`` rows, whatever the size of the tables
    joined = rows.join(F.broadcast(some), "doc_id", "left").where(F.col("quality").isNotNull() | drawn("doc_id", pool / max(1, n_docs), last=True))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, lang, source, n_chars, quality in blocks(batches):
            views = _views(text, lang, source, n_chars)
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "quality": [-1 if q is None else q for q in quality], "one": [v.astype("<f4").tobytes() for v in views[0]], "two": [v.astype("<f4").tobytes() for v in views[1]]})

    got = staged(joined.mapInArrow(extract, "doc_id long, quality long, one binary, two binary"), "quality-sample")
    # one row for each document: those that repeat a doc_id don't add up
    got = got.groupBy("doc_id").agg(F.min(F.struct("quality", "one", "two")).alias("row")).select("doc_id", "row.*").orderBy("doc_id").collect()
    if not got:
        return co_train([np.zeros((0, _TEXT)), np.zeros((0, 2 * _BUCKETS + 2))], np.zeros(0, np.int64), np.zeros(0, bool))
    label = np.array([r["quality"] for r in got])
    apart = np.array([zlib.crc32(f"apart{r['doc_id']}".encode()) % 4 == 0 for r in got])
    return co_train([np.stack([np.frombuffer(r[c], "<f4") for r in got]).astype(float) for c in ("one", "two")], label, apart)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for each row of ``docs`` (doc_id, text, lang, source, n_chars).

    Null texts count as empty; texts of any length are scored whole, with the same features; equal rows
    (ties) get equal scores; null metadata are a value of their own; rows without a doc_id are left
    out; repeated rows get equal scores; an empty table gives an empty result; extra columns are ignored.
    Without labels of both kinds everything is kept.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, lang, source, n_chars in blocks(batches):
            one, two, both = apply_model(model, _views(text, lang, source, n_chars))
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "text_score": one, "meta_score": two, "score": both, "keep": both >= model["threshold"]})

    return _rows(docs).mapInArrow(apply, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps; rows without a doc_id go."""
    model = train(docs, labels)

    def chosen(text: list[str], lang: list, source: list, n_chars: list) -> list[bool]:
        return (apply_model(model, _views(text, lang, source, n_chars))[2] >= model["threshold"]).tolist()

    needed = {"text_": F.coalesce(F.col("text").cast("string"), F.lit("")), "lang_": F.col("lang").cast("string"), "source_": F.col("source").cast("string"), "n_chars_": F.col("n_chars").cast("long")}
    return only(docs.where(F.col("doc_id").isNotNull()), needed, chosen)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """train() and score() in turn."""
    return score(docs, train(docs, labels))
