"""Importance resampling towards a target distribution, over hashed word n-grams.

Both the documents and the target texts are counted into BUCKETS buckets of their runs of 1 to 3 words; a
bucket's gain is the logarithm of the ratio of its smoothed shares. A document's weight is the sum of its
features' gains; with Gumbel noise from a hash of its doc_id, the highest scores are a draw without
replacement in proportion to the exponential of the weights.

The draw is an external merge: each task sorts its eligible rows into runs and cuts them where the score
ranges end; a range's pieces come together by a shuffle, in order of their first rows, and a tournament tree
merges them, taking a piece in only when its turn comes. Ranges are bounded by RANGE_ROWS drawn rows, their
counts give the first rank of each, ranges beyond the draw are never merged, and the last one stops at the
exact count.

A word's crc32 is computed for all words of many texts at once; that of a run of words follows from
those of its words, as the checksum is linear.

Defined cases: null and empty texts have no features and weight 0; rows whose identifier is null are left out,
of the counts too; rows that share a doc_id are scored each on its own text and tie where these are equal
(of equal rows, as many are drawn as fit); equal scores rank by ascending doc_id; without target texts, or
without any words in them, gains come from the smoothing alone; texts of any length are read whole; an empty
table gives an empty result; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slots, staged, texts
from .shingles import _grouped, _pieces, blocks

BUCKETS, RUN = 10_000, 3
#: Rows that a task sorts at once, rows of a piece of a run, and drawn rows of a score range.
RUN_ROWS, PIECE_ROWS, RANGE_ROWS = 1 << 17, 1024, 1 << 18

_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Words up to this length are summed in step, longer ones one by one; shifts by less are one lookup.
_SHORT = 64


@functools.cache
def _byte_table() -> np.ndarray:
    """What one more byte makes of the low byte of a crc32 register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _shift(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


@functools.cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that shift a register by 0 to 63 zero bytes, and by 64, 128, 256, ... ones."""
    one = _byte_table()
    by = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    for _ in range(_SHORT):
        c = by[-1]
        by.append(one[c & 255] ^ (c >> 8))
    large = [by.pop()]
    for _ in range(30):
        large.append(_shift(large[-1], large[-1]))
    return np.stack(by), large


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums after so many zero bytes, so that ``shifted(crc(a), len(b)) ^ crc(b)`` is ``crc(a + b)``."""
    near, large = _shifts()
    low = sizes % _SHORT * 256
    out = near[:, 0].ravel()[low + (crc & 255)] ^ near[:, 1].ravel()[low + ((crc >> 8) & 255)] ^ near[:, 2].ravel()[low + ((crc >> 16) & 255)] ^ near[:, 3].ravel()[low + (crc >> 24)]
    high = sizes // _SHORT
    for bit, table in enumerate(large):
        at = np.flatnonzero(high >> bit & 1)
        if not len(at) and not (high >> bit).any():
            break
        out[at] = _shift(table, out[at])
    return out


def _one_more(crc: np.ndarray, byte: int) -> np.ndarray:
    """Checksums after one more byte."""
    return ~(_byte_table()[(~crc ^ np.uint32(byte)) & 255] ^ (~crc >> np.uint32(8)))


def word_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and crc32 of the words of some bytes in lower case."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], _CLASS[data].view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    table, crc = _byte_table(), np.full(len(start), 0xFFFFFFFF, np.uint32)
    short = size <= _SHORT
    order = np.argsort(np.where(short, -size, 0), kind="stable")  # longest first: those still running are a prefix
    running, at = crc[order], start[order]
    for i, n in enumerate((np.count_nonzero(short) - np.searchsorted(np.sort(size[short]), np.arange(_SHORT), "right")).tolist()):
        if not n:
            break
        running[:n] = table[(running[:n] ^ data[at[:n] + i]) & 255] ^ (running[:n] >> np.uint32(8))
    crc[order] = ~running
    for i in np.flatnonzero(~short):
        crc[i] = zlib.crc32(raw[start[i]:end[i]])
    return start, size, crc


def features(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Numbers of some texts, words of each, and for each length of run the features' texts (ascending) and buckets.

    A long text comes in several turns; what comes of a text is summed up.
    """
    for group in _grouped(raws):
        if len(group) > 1:
            pieces, ends = [b" ".join([raws[i].lower() for i in group])], np.cumsum([len(raws[i]) + 1 for i in group])
        else:
            pieces, ends = _pieces(raws[group[0]].lower()), None
        size, crc = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for piece in pieces:
            old = min(len(size), RUN - 1)  # the words before this piece that runs reach back to
            start, new_size, new_crc = word_sums(piece)
            size, crc = np.r_[size[len(size) - old:], new_size], np.r_[crc[len(crc) - old:], new_crc]
            text = np.zeros(len(size), np.int64) if ends is None else np.searchsorted(ends, start, "right")
            out, whole = [(text[old:], crc[old:] % np.uint32(BUCKETS))], crc
            for n in range(2, RUN + 1):
                whole = shifted(_one_more(whole[:max(0, len(size) - n + 1)], 32), size[n - 1:]) ^ crc[n - 1:]
                inside = text[:len(whole)] == text[n - 1:]
                inside[:max(0, old - n + 1)] = False
                out.append((text[:len(whole)][inside], whole[inside] % np.uint32(BUCKETS)))
            yield np.array(group), np.bincount(text[old:], minlength=len(group)), out


def bucket_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket; each task sends its BUCKETS sums."""

    def count(batches):
        out = np.zeros(BUCKETS, np.int64)
        for (bodies,) in blocks(batches):
            for _, _, runs in features([b.encode() for b in bodies]):
                for _, bucket in runs:
                    out += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], ["bucket", "n"])

    sums = texts(docs, id_col, text_col).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths of a natural logarithm, rounded down."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: str, seed: int = 42):
    """Gumbel noise in thousandths, from a hash of the identifier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""

    def weigh(batches):
        for ids, bodies in blocks(batches):
            words, n, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for group, count, runs in features([b.encode() for b in bodies]):
                words[group] += count
                for text, bucket in runs:
                    held = np.bincount(text, minlength=len(group))
                    n[group] += held
                    weight[group] += np.diff(np.r_[0, np.cumsum(gain[bucket])][np.r_[0, np.cumsum(held)]])  # integers: exact at any length
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise("doc_id", seed))


class TournamentTree:
    """Winners' tree over sorted runs: each inner node names the leaf whose head comes first below it.

    A run is an iterator of (score, doc_id, ...) rows in order of descending score, then ascending doc_id.
    Taking the first row of all replays one path of the tree. Runs can be added while merging: they get the
    leaves of ended ones, and the tree doubles when there are none.
    """

    def __init__(self):
        self.leaves, self.runs, self.heads, self.tree, self.free = 1, [None], [None], [0, 0], [0]

    @staticmethod
    def key(row) -> tuple[int, int]:
        return -row[0], row[1]

    def add(self, run: Iterator) -> None:
        head = next(run, None)
        if head is None:
            return
        if not self.free:
            n = self.leaves
            self.free = list(range(2 * n - 1, n - 1, -1))
            self.runs += [None] * n
            self.heads += [None] * n
            self.leaves, self.tree = 2 * n, [0] * (2 * n) + list(range(2 * n))
            for node in range(2 * n - 1, 0, -1):
                self._play(node)
        leaf = self.free.pop()
        self.runs[leaf], self.heads[leaf] = run, head
        self._replay(leaf)

    def first(self):
        """The row that comes first, without taking it; None when all runs have ended."""
        return self.heads[self.tree[1]]

    def take(self):
        """The row that comes first."""
        leaf = self.tree[1]
        row, self.heads[leaf] = self.heads[leaf], next(self.runs[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)
        return row

    def rest(self) -> Iterator:
        """All rows left, in any order."""
        for head, run in zip(self.heads, self.runs, strict=True):
            if head is not None:
                yield head
                yield from run

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self.tree[node] = b if x is None or y is not None and self.key(y) < self.key(x) else a

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.leaves) // 2
        while node and self.leaves > 1:
            self._play(node)
            node //= 2


def _blocks_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, joined to blocks of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


_PIECE = pa.schema([("part", pa.int32()), ("top", pa.int64()), ("low", pa.int64()), *[(c, pa.binary()) for c in ("scores", "ids", "features", "weights")]])


def _rows_of(piece: dict) -> Iterator[tuple[int, int, int, int]]:
    """score, doc_id, n_features, weight of a piece's rows."""
    return zip(*(np.frombuffer(piece[c], "<i8").tolist() for c in ("scores", "ids", "features", "weights")), strict=True)


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    score, ids, n, weight, rank = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, n, weight, score, rank)], ["doc_id", "n_features", "weight", "score", "rank"])


def _split(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each score, 0 being the one of the highest: how many of the descending bounds are above it."""
    return np.searchsorted(-bounds, -score, "left")


def draw(rows: DataFrame, count: int, eligible: str, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, 3, ... of the ``count`` best eligible rows, else null).

    ``rows`` has those columns but the rank, and those of the condition ``eligible``; it is read more than
    once, so it should be a written table.
    """
    columns = ["doc_id", "n_features", "weight", "score"]
    plain = rows.select(*columns, F.lit(None).cast("long").alias("rank"), F.coalesce(F.expr(eligible), F.lit(False)).alias("able"))
    able = plain.where("able").select(*columns)
    total = able.count()
    count = min(count, total)
    if count <= 0:
        return plain.drop("able")
    ranges = -(-count // range_rows)
    shares = [i / ranges for i in range(1, ranges + 1)] + [1.02, 1.2, 2]  # those beyond the draw: percentiles are near, not exact
    bounds = able.agg(F.percentile_approx("score", [max(0.0, 1 - count * x / total) for x in shares], 100_000)).first()[0]
    bounds = np.unique(np.array(bounds, np.int64))[::-1]

    def tally(batches):
        out = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            out += np.bincount(_split(batch.column(0).to_numpy(), bounds), minlength=len(out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["part", "n"])

    held = dict(able.select("score").mapInArrow(tally, "part int, n long").groupBy("part").agg(F.sum("n")).collect())  # one row a range
    before = np.r_[0, np.cumsum([held.get(i, 0) for i in range(len(bounds) + 1)])].tolist()
    drawn = next(i for i, n in enumerate(before) if n >= count)  # so many ranges hold all of the draw

    def runs(batches):
        """Sorted runs, cut into pieces that lie within a range."""
        for block in _blocks_of(batches, run_rows):
            ids, n, weight, score = (c.to_numpy() for c in block.columns)
            order = np.lexsort((ids, -score))
            ids, n, weight, score = (c[order].astype("<i8") for c in (ids, n, weight, score))
            part = _split(score, bounds)
            for p in range(drawn):
                a, b = np.searchsorted(part, (p, p + 1)).tolist()
                for at in range(a, b, PIECE_ROWS):
                    cut = slice(at, min(b, at + PIECE_ROWS))
                    yield pa.RecordBatch.from_pylist([{"part": p, "top": int(score[at]), "low": int(ids[at]), "scores": score[cut].tobytes(), "ids": ids[cut].tobytes(), "features": n[cut].tobytes(), "weights": weight[cut].tobytes()}], _PIECE)

    def merge(pieces: Iterator[dict], rank: int) -> Iterator[tuple]:
        """A range's rows in order, with ranks up to the draw's end; ``pieces`` come in order of their first rows."""
        tree, piece = TournamentTree(), next(pieces, None)
        while True:
            while piece and (tree.first() is None or (-piece["top"], piece["low"]) < tree.key(tree.first())):
                tree.add(_rows_of(piece))
                piece = next(pieces, None)
            if tree.first() is None or rank == count:
                break
            rank += 1
            yield *tree.take(), rank
        left = itertools.chain([piece] if piece else [], pieces)  # beyond the draw: neither ordered nor ranked
        for row in itertools.chain(tree.rest(), itertools.chain.from_iterable(map(_rows_of, left))):
            yield *row, None

    def merged(batches):
        pieces = (row for batch in batches for row in batch.to_pylist())
        for p, group in itertools.groupby(pieces, key=lambda row: row["part"]):
            rows_ = merge(group, before[p])
            while block := list(itertools.islice(rows_, 4 * PIECE_ROWS)):
                yield _ranked(block)

    pieces = able.mapInArrow(runs, "part int, top long, low long, scores binary, ids binary, features binary, weights binary")
    ranked = pieces.repartition(min(drawn, slots(rows.sparkSession)), "part").sortWithinPartitions("part", F.desc("top"), "low").mapInArrow(merged, "doc_id long, n_features long, weight long, score long, rank long")
    apart = ~F.col("able") if drawn > len(bounds) else ~F.col("able") | (F.col("score") < int(bounds[drawn - 1]))
    return ranked.unionByName(plain.where(apart).drop("able"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, target_id: str = "item_id", seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words towards the target's distribution."""
    gain = gains(bucket_counts(docs, "doc_id"), bucket_counts(target, target_id))
    rows = staged(scored(docs, gain, seed), "resampling")
    able = f"n_words >= {int(least_words)}"
    return draw(rows, rows.where(able).count() * percent // 100, able, range_rows)
