"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

Units of a text are its words (single letters in a row make one unit). Each unit is a sequence of
letters between two boundary marks; letters beyond ASCII are three classes by their last byte (dropping
the accents instead lost 9 of 131 toxic documents), digits stand for the letters they look like, other
characters are left out. The kernel counts subsequences of three symbols, each occurrence weighing
DECAY to the power of the symbols it skips (within SPAN symbols), so gaps and inserted characters weaken
a match but don't break it; a sentence's weights are the sum of its units'. Landmarks are units that
toxic and other labelled documents use differently, frequent units and drawn ones. The machine is fitted
on sentences, mapped to their kernel values with the landmarks, whitened (Nyström): of every toxic
document the WORST sentences that look worst, of every other one these and a drawn one; they are chosen
anew in each round. As the kernel is an inner product of subsequence weights, the machine's
decision - a combination of landmarks - is summed up in one table of subsequence weights, with which
all sentences and units of every text are scored in bulk. A document's score comes from these decisions
by a calibrated logistic model.

Only the text is an input of a score. Fitting uses about SAMPLE toxic and twice as many other labelled
documents at most, chosen by a hash of doc_id, never those that are held out; calibration weighs them
back to their true shares. Sentences are found and mapped on the executors: the driver sees landmarks
and kernel values, no texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, small_batches, staged
from .quality import logistic, logits, sigmoid
from .shingles import PIECE, _grouped, _pieces, blocks
from .suffix_dedup import PrefixHash, mixed

SAMPLE, LANDMARKS, ROUNDS, WORST = 1_200, 480, 3, 3
DECAY, SPAN = 0.6, 7
THRESHOLD = 0.7
#: Telling landmarks whose copies with an inserted letter are learned, too, as sentences of one unit.
SPOILT = 100
#: Bytes of a unit that are looked at together; longer units are cut into overlapping stretches of this length.
WIDTH = 64
_BEGIN, _END = 27, 28
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:192] = 29 + np.arange(64) % 3
# Digits and the letters they look like.
for _digit, _letter in zip("013457", "oieast", strict=True):
    _CODE[ord(_digit)] = ord(_letter) - 96
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
_PAIRS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


def unit_bounds(data: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units: words, with runs of single-letter words joined, cut into stretches of WIDTH."""
    edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate(([0], np.cumsum((codes > 0) & (codes < _BEGIN))))
    single = (letters[end] - letters[start] == 1) & (end - start <= 3)
    if single.any():
        joined = np.r_[False, single[1:] & single[:-1] & (start[1:] - end[:-1] == 1)]
        first = np.flatnonzero(~joined)
        start, end = start[first], end[np.append(first[1:], len(joined)) - 1]
    if len(start) and (end - start).max() > WIDTH:
        step = WIDTH // 2
        pieces = np.maximum(1, -(-(end - start - WIDTH) // step) + 1)
        start = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
        end = np.minimum(np.repeat(end, pieces), start + WIDTH)
    return start, end


def _matrix(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Symbols of units, a row each, between the boundary marks."""
    at = np.arange(width)
    codes = symbols[np.minimum(start[:, None] + at, len(symbols) - 1)]
    codes[at >= (end - start)[:, None]] = 0
    codes = np.take_along_axis(codes, np.argsort(codes == 0, axis=1, kind="stable"), 1)
    out = np.zeros((len(start), width + 2), np.int32)
    out[:, 0] = _BEGIN
    out[:, 1:-1] = codes
    out[np.arange(len(start)), (codes > 0).sum(axis=1) + 1] = _END
    return out


def _norm(codes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1, (codes > 0).sum(axis=1) - 2))


def decisions(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner product of each unit's normalised subsequence weights with the table's."""
    total, table = np.zeros(len(codes)), table.astype(np.float32)
    padded = np.zeros((len(codes), codes.shape[1] + SPAN), np.int32)
    padded[:, :codes.shape[1]] = codes
    n = codes.shape[1]
    for j, k in _PAIRS:
        index = (padded[:, :n] * 32 + padded[:, j:n + j]) * 32 + padded[:, k:n + k]
        total += table[index].sum(axis=1) * DECAY ** (k - 2)
    return total / _norm(codes)


def subsequences(codes: np.ndarray, row: np.ndarray | None = None, rows: int = 0) -> np.ndarray:
    """The units' normalised subsequence weights in full, summed up by ``row`` (default: a row each)."""
    row, rows = (np.arange(len(codes)), len(codes)) if row is None else (row, rows)
    out = np.zeros(rows * 32 ** 3, np.float32)
    n = int((codes > 0).sum(axis=1).max()) if len(codes) else 0
    padded = np.zeros((len(codes), n + SPAN), np.int32)
    padded[:, :n] = codes[:, :n]
    norm = _norm(codes).astype(np.float32)
    for j, k in _PAIRS:
        a, b, c = padded[:, :n], padded[:, j:n + j], padded[:, k:n + k]
        unit, at = np.nonzero((a > 0) & (b > 0) & (c > 0))
        np.add.at(out, row[unit] * 32 ** 3 + (a[unit, at] * 32 + b[unit, at]) * 32 + c[unit, at], np.float32(DECAY ** (k - 2)) / norm[unit])
    return out.reshape(rows, 32 ** 3)


class Units:
    """Units of many texts, each distinct one once, and the sentences they are in."""

    def __init__(self, raws: list[bytes]):
        self.texts = len(raws)
        number, sentence, parts, base = [], [], [], 0
        for group in _grouped(raws):
            pieces = list(_pieces(raws[group[0]])) if len(group) == 1 and len(raws[group[0]]) > PIECE else [b" \n ".join([raws[i] for i in group])]
            sizes = np.cumsum([len(raws[i]) + 3 for i in group])
            for piece in pieces:
                data = np.frombuffer(piece, np.uint8)
                codes = _CODE[data]
                start, end = unit_bounds(data, codes)
                stops = np.cumsum(_STOP[data])
                if len(start):
                    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
                    h = mixed(PrefixHash(lower).of(start, end - start) + (end - start).astype(np.uint64))
                    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                    number.append(np.array(group)[np.searchsorted(sizes, start, "right") if len(pieces) == 1 else np.zeros(len(start), np.int64)])
                    sentence.append(base + stops[start])
                    parts.append((codes, start[first], end[first], inverse))
                base += int(stops[-1]) if len(stops) else 0  # a sentence goes on in the text's next piece
            base += 1
        self.number = np.concatenate(number) if number else np.zeros(0, np.int64)
        self.parts = parts
        ids = np.concatenate(sentence) if sentence else np.zeros(0, np.int64)
        #: Per sentence its first unit and number of units; per unit its sentence.
        self.first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(self.first, len(ids)))
        self.sentence = np.repeat(np.arange(len(self.first)), self.count)

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(numbers of units within a part, their symbols, size of the part's distinct units, inverse) by width."""
        for symbols, start, end, inverse in self.parts:
            size, at = end - start, []
            for low, high in ((0, 8), (8, 16), (16, 32), (32, WIDTH)):
                rows = np.flatnonzero((size > low) & (size <= high))
                for a in range(0, len(rows), 20_000):
                    at.append((rows[a:a + 20_000], high))
            yield from ((rows, _matrix(symbols, start[rows], end[rows], high), len(start), inverse) for rows, high in at)

    def decide(self, table: np.ndarray) -> np.ndarray:
        """The table's inner product with every unit, in the order of ``number``."""
        out, current, own = [], None, None
        for rows, codes, n, inverse in self.codes():
            if inverse is not current:
                if own is not None:
                    out.append(own[current])
                current, own = inverse, np.zeros(n)
            own[rows] = decisions(codes, table)
        if own is not None:
            out.append(own[current])
        return np.concatenate(out) if out else np.zeros(0)

    def per_sentence(self, value: np.ndarray) -> np.ndarray:
        """The sum over a sentence's units, dampened by their number."""
        return np.add.reduceat(value, self.first) / np.sqrt(self.count) if len(self.first) else np.zeros(0)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """Symbols of the units ``at``, a row each."""
        base = np.cumsum([0] + [len(p[3]) for p in self.parts])
        part = np.searchsorted(base, at, "right") - 1
        out = np.zeros((len(at), WIDTH + 2), np.int32)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            symbols, start, end, inverse = self.parts[p]
            of = inverse[at[rows] - base[p]]
            out[rows] = _matrix(symbols, start[of], end[of], WIDTH)
        return out


def _pooled(number: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Per text: highest decision, mean of the three highest, number and share of positive ones, sum of positive ones, all dampened."""
    out = np.zeros((texts, 6))
    out[:, :2] = -2
    order = np.lexsort((-value, number))
    number, value = number[order], value[order]
    if not len(value):
        return out
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    count = np.diff(np.append(first, len(number)))
    top = np.stack([np.where(count > i, value[np.minimum(first + i, len(value) - 1)], -2) for i in range(3)], axis=1)
    positive = np.maximum(value, 0)
    out[number[first]] = np.stack((
        np.clip(top[:, 0], -2, 4), np.clip(top.mean(axis=1), -2, 4), np.log1p(np.add.reduceat((value > 0).astype(float), first)),
        10 * np.sqrt(np.add.reduceat((value > 0).astype(float), first) / count), np.log1p(np.add.reduceat(positive, first)), 10 * np.sqrt(np.add.reduceat(np.maximum(value - 0.5, 0), first) / count)), axis=1)
    return out


def document_features(raws: list[bytes], table: np.ndarray, constant: float) -> np.ndarray:
    """The pooled decisions of each text's sentences and of its units, each taken as a sentence of its own."""
    units = Units(raws)
    value = units.decide(table)
    whole = _pooled(units.number[units.first], units.per_sentence(value) + constant, units.texts)
    return np.hstack((whole, _pooled(units.number, value + constant, units.texts)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 5.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last weight is the constant."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, damp = np.zeros(x.shape[1]), np.ones(x.shape[1])
    damp[-1] = 1e-3
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        xs = x[on] * (cost * weight[on])[:, None]
        step = np.linalg.solve(np.diag(damp) + xs.T @ x[on], damp * w - xs.T @ (y[on] * margin[on]))
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where to cut a decision value for the best harmonic mean of precision and recall."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(np.where(y == 1, weight, 0)[order])
    value = 2 * hit / (np.cumsum(weight[order]) + weight[y == 1].sum())
    k = int(value.argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def inserted(codes: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Two copies of each unit of four letters or more, with a letter put in somewhere inside."""
    out = []
    for row in codes:
        n = int((row > 0).sum())
        for _ in range(2 if 6 <= n < len(row) else 0):
            at = int(draw.integers(2, n - 1))
            out.append(np.concatenate((row[:at], [int(draw.integers(1, 27))], row[at:-1])))
    return np.array(out, np.int32).reshape(-1, codes.shape[1])


class Nystroem:
    """Whitened kernel values with landmarks, given as rows of symbols."""

    def __init__(self, landmarks: np.ndarray):
        self.vectors = subsequences(landmarks)
        value, vector = np.linalg.eigh((self.vectors @ self.vectors.T).astype(float))
        keep = value > 1e-6 * value.max()
        self.map = np.ascontiguousarray(self.vectors.T @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32))
        self.used = np.flatnonzero(self.map.any(axis=1))
        self.map = self.map[self.used]

    def of(self, codes: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
        return kernel_values(self.used, self.map, codes, sentence, sentences)

    def table(self, w: np.ndarray) -> np.ndarray:
        """The subsequence weights of a combination of the values."""
        out = np.zeros(32 ** 3)
        out[self.used] = self.map @ w
        return out


def kernel_values(used: np.ndarray, whitened: np.ndarray, codes: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
    """Whitened values of sentences, from their units' symbols and each unit's sentence (ascending)."""
    out = []
    for a in range(0, sentences, 256):
        low, high = np.searchsorted(sentence, (a, a + 256))
        n = np.bincount(sentence[low:high] - a, minlength=min(256, sentences - a))
        rows = subsequences(codes[low:high], sentence[low:high] - a, len(n))
        out.append((rows[:, used] @ whitened) / np.sqrt(np.maximum(n, 1))[:, None])
    return np.concatenate(out) if out else np.zeros((0, whitened.shape[1]))


def unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit (its symbols), and the numbers of toxic and other documents with it; input: doc_id, text, toxic."""
    for _, text, toxic in blocks(batches):
        raws, toxic = [t.encode() for t in text], np.array(toxic)
        units = Units(raws)
        codes = units.matrix(np.arange(len(units.number))).astype(np.uint8)
        names, inverse = np.unique(codes.view(f"S{codes.shape[1]}").ravel(), return_inverse=True)
        pairs = np.unique(inverse * np.int64(len(raws)) + units.number)
        name, bad = pairs // len(raws), toxic[pairs % len(raws)] == 1
        yield pa.RecordBatch.from_pydict({"unit": names.tolist(), "bad": np.bincount(name[bad], minlength=len(names)), "good": np.bincount(name[~bad], minlength=len(names))}, schema=pa.schema([("unit", pa.binary()), ("bad", pa.int64()), ("good", pa.int64())]))


def _symbols(units: list) -> np.ndarray:
    out = np.zeros((len(units), WIDTH + 2), np.int32)
    for row, unit in zip(out, units, strict=True):
        row[:len(unit)] = np.frombuffer(bytes(unit), np.uint8)
    return out


def choose_landmarks(sample: DataFrame, n_bad: int, n_good: int) -> tuple[np.ndarray, int]:
    """Symbols of at most LANDMARKS units, and how many of them, in front, toxic documents use more."""
    counts = staged(sample.mapInArrow(unit_counts, "unit binary, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-units")
    lift = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    # how far the documents with a unit are from having the usual share of toxic ones
    usual = (F.col("bad") + F.col("good")) * n_bad / (n_bad + n_good)
    rows = counts.withColumns({"lift": lift, "evidence": (F.col("bad") - usual) / F.sqrt(usual + 1)})

    def first(where: str, order: list, n: int) -> list:
        return [r["unit"] for r in rows.where(where).orderBy(*order, "unit").select("unit").limit(n).collect()]

    telling = first("bad >= 3 and lift > 1.2 and evidence > 3", [F.col("evidence").desc()], LANDMARKS * 2 // 3) or first("bad > 0", [F.col("evidence").desc()], LANDMARKS // 6)
    common = first("good > 0 and lift < 0.3", [F.col("good").desc()], LANDMARKS // 6)
    rare = first("good > 0 and lift < 0.3", [F.xxhash64("unit")], LANDMARKS // 6)
    return _symbols(telling + [u for u in dict.fromkeys(common + rare) if u not in set(telling)]), len(telling)


def _chosen_sentences(shared, table: np.ndarray):
    """Per document the values of its WORST worst sentences, and of one drawn by the document's number."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, toxic in blocks(batches, 128):
            units = Units([t.encode() for t in text])
            value = units.per_sentence(units.decide(table))
            number = units.number[units.first]
            order = np.lexsort((-value, number))
            start = np.flatnonzero(np.r_[True, number[order][1:] != number[order][:-1]]) if len(order) else order
            count = np.diff(np.append(start, len(order)))
            other = start + np.array([zlib.crc32(f"sentence{doc_id[i]}".encode()) % n for i, n in zip(number[order][start], count, strict=True)], np.int64)
            most = np.concatenate([start[count > i] + i for i in range(WORST)])
            picked = np.concatenate((order[most], order[other]))
            by = np.argsort(picked, kind="stable")
            at = np.flatnonzero(np.isin(units.sentence, picked))
            own = np.unique(picked)
            values = kernel_values(*shared.value, units.matrix(at), np.searchsorted(own, units.sentence[at]), len(own)).astype("<f4")
            worst = (np.arange(len(picked)) < len(most))[by]
            of = number[picked[by]]
            yield pa.RecordBatch.from_pydict({"doc_id": [doc_id[i] for i in of], "toxic": [toxic[i] for i in of], "worst": worst.tolist(), "body": [values[i].tobytes() for i in np.searchsorted(own, picked[by])]}, schema=pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("worst", pa.bool_()), ("body", pa.binary())]))

    return choose


def _pooled_sample(table: np.ndarray, constant: float):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text, toxic in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "toxic": toxic, "body": [x.tobytes() for x in document_features([t.encode() for t in text], table, constant)]})

    return pool


def fit(sample: DataFrame, share: tuple[float, float] = (1.0, 1.0)) -> dict:
    """The model from doc_id, text, toxic rows: a table of subsequence weights with its constant, and a document's weights.

    ``share``: which part of all other and of all toxic labelled documents the sample holds.
    """
    apart = F.pmod(F.crc32(F.concat(F.lit("apart"), "doc_id").cast("binary")), F.lit(3)) == 0
    n = {r[0]: r[1] for r in sample.where(~apart).groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {"table": np.zeros(32 ** 3), "constant": -1.0, "document": np.r_[np.zeros(12), 30.0 if 1 in n and 0 not in n else -30.0]}
    fitting = sample.where(~apart)
    marks, telling = choose_landmarks(fitting, n[1], n[0])
    nystroem, draw = Nystroem(marks), np.random.default_rng(7)
    spoilt = inserted(marks[:min(telling, SPOILT)], draw)
    extra = nystroem.of(spoilt, np.arange(len(spoilt)), len(spoilt))
    # at first, the worst sentences are those most like the telling landmarks
    table = nystroem.vectors[:telling].mean(axis=0) - (nystroem.vectors[telling:].mean(axis=0) if telling < len(marks) else 0)
    # at most LANDMARKS columns of the subsequences that landmarks have, sent once
    shared = sample.sparkSession.sparkContext.broadcast((nystroem.used, nystroem.map))
    for _ in range(ROUNDS):
        rows = fitting.mapInArrow(_chosen_sentences(shared, table.astype(np.float32)), "doc_id long, toxic long, worst boolean, body binary")
        # WORST + 1 short rows of numbers at most for each document of the bounded sample
        got = rows.where("toxic = 0 or worst").orderBy("doc_id", "worst").collect()
        x = np.concatenate((np.stack([np.frombuffer(r["body"], "<f4") for r in got]), extra)).astype(float) if got else extra
        y = np.r_[[1.0 if r["toxic"] else -1.0 for r in got], np.ones(len(spoilt))]
        weight = np.r_[np.ones(len(got)), np.full(len(spoilt), 0.2)]
        weight = np.where(y > 0, weight / max(weight[y > 0].sum(), 1e-9), weight / max(weight[y < 0].sum(), 1e-9)) * len(y) / 2
        w = svm(x, y, weight)
        table, constant = nystroem.table(w[:-1]).astype(np.float32), float(w[-1])
    shared.destroy()
    rows = staged(sample.withColumn("apart", apart).where("apart").drop("apart").mapInArrow(_pooled_sample(table, constant), "doc_id long, toxic long, body binary"), "toxic-pooled").orderBy("doc_id").collect()
    if len({r["toxic"] for r in rows}) < 2:
        rows = sample.mapInArrow(_pooled_sample(table, constant), "doc_id long, toxic long, body binary").orderBy("doc_id").collect()
    features, toxic = np.stack([np.frombuffer(r["body"]) for r in rows]), np.array([r["toxic"] for r in rows])
    weight = np.where(toxic == 1, 1 / share[1], 1 / share[0])
    document = logistic(features, toxic.astype(float), weight / weight.mean(), 0.5)
    document[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(logits(features, document), toxic, weight)
    return {"table": table, "constant": constant, "document": document}


def apply_model(model: dict, raws: list[bytes]) -> np.ndarray:
    return sigmoid(logits(document_features(raws, model["table"], model["constant"]), model["document"]))


def held_out(doc_id) -> F.Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on about ``sample`` labelled documents that aren't held out; labels: doc_id, toxic (1 or 0)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = tuple(min(1.0, n / max(1, total.get(value, 0))) for value, n in ((0, 2 * sample), (1, sample)))
    some = known.where(F.when(F.col("toxic") == 1, drawn("doc_id", share[1])).otherwise(drawn("doc_id", share[0])))
    # about three times ``sample`` documents, whatever the size of the tables, one row for each: broadcast
    rows = _rows(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").cast("long").alias("toxic"))
    return fit(staged(rows, "toxic-sample"), share)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Null texts count as empty; empty texts get the score of a text without units; texts of any length
    are scored whole; rows without a doc_id are left out; repeated rows get equal scores; an empty
    table gives an empty result; extra columns are ignored. Labels of one kind only give one constant score.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "score": apply_model(model, [t.encode() for t in text])})

    got = _rows(docs).mapInArrow(apply, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """train() and score() in turn."""
    return score(docs, train(docs, labels))
