"""Exact deduplication with a log-structured merge (LSM) index over digests.

Every text is normalised (white space deleted) and digested in the JVM. Each task streams the digests of
its rows, batch by batch, into a memtable of bounded size, which flushes sorted runs - one entry for each
digest, with the best row and a count. Runs are cut by digest range; per range they are added to an index
that merges sorted runs of like sizes (compaction keeps per digest the best identifier), and every run's
digests are then looked up among those that several rows share: the filter rejects the others, hits are
found by binary search. So a digest that a third of all rows hold is one entry per run everywhere. Hits
receive byte verification against the row that stays, in chunks of bounded size; rows whose bytes differ
in spite of an equal digest are grouped anew by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slots, staged, texts

#: Entries that a memtable holds before it is flushed as a sorted run.
MEMTABLE = 65_536
#: Entries of a digest range, about: what one compaction holds.
RANGE = 1 << 20
#: Bits of a run's Bloom filter for each entry, and hash functions.
FILTER_BITS, FILTER_HASHES = 10, 5
#: Copies that are compared with the row that stays in one task at most.
CHUNK = 256
_ENTRY = np.dtype([("digest", "S32"), ("points", "<i8"), ("doc_id", "<i8"), ("count", "<i8")])


class BloomFilter:
    """Bits over 32-byte digests; the digest's own 8-byte words serve as hashes (double hashing)."""

    def __init__(self, n: int = 0, bits: np.ndarray | None = None):
        self.bits = np.zeros(max(64, 1 << max(0, int(n * FILTER_BITS - 1).bit_length())) // 8, np.uint8) if bits is None else bits

    def _at(self, digests: np.ndarray) -> np.ndarray:
        words = np.frombuffer(np.ascontiguousarray(digests).tobytes(), "<u8").reshape(len(digests), 4)
        size = np.uint64(len(self.bits) * 8 - 1)
        return (words[:, :1] + np.arange(FILTER_HASHES, dtype=np.uint64) * (words[:, 1:2] | np.uint64(1))) & size

    def add(self, digests: np.ndarray) -> None:
        at = self._at(digests).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def might_have(self, digests: np.ndarray) -> np.ndarray:
        at = self._at(digests)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _sorted_run(entries: np.ndarray) -> np.ndarray:
    """Sorted by digest, one entry each: the most code points, then the smallest identifier, win; counts add up."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["doc_id"], -entries["points"], entries["digest"]))]
    first = np.flatnonzero(np.r_[True, entries["digest"][1:] != entries["digest"][:-1]])
    out = entries[first].copy()
    out["count"] = np.add.reduceat(entries["count"], first)
    return out


def merge_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs as one: each entry goes to its place, and of equal digests the better one stays."""
    out = np.empty(len(a) + len(b), _ENTRY)
    out[np.arange(len(a)) + np.searchsorted(b["digest"], a["digest"], "left")] = a
    out[np.arange(len(b)) + np.searchsorted(a["digest"], b["digest"], "right")] = b
    twice = np.flatnonzero(out["digest"][1:] == out["digest"][:-1])
    x, y = out[twice], out[twice + 1]
    better = (y["points"] > x["points"]) | (y["points"] == x["points"]) & (y["doc_id"] < x["doc_id"])
    best = np.where(better, y, x)
    best["count"] = x["count"] + y["count"]
    out[twice] = best
    return np.delete(out, twice + 1)


class LsmIndex:
    """A memtable, sorted runs with filters, compaction and point lookups. Digests are 32 bytes."""

    def __init__(self, memtable: int = MEMTABLE, tiered: bool = True):
        self.limit, self.tiered, self.memtable, self.held, self.runs = memtable, tiered, [], 0, []
        #: Digests that lookups gave to filters, and those that filters rejected.
        self.probed = self.rejected = 0

    def put(self, digest: np.ndarray, points: np.ndarray, doc_id: np.ndarray) -> None:
        for at in range(0, len(digest), self.limit):
            part = np.zeros(min(self.limit, len(digest) - at), _ENTRY)
            end = at + len(part)
            part["digest"], part["points"], part["doc_id"], part["count"] = digest[at:end], points[at:end], doc_id[at:end], 1
            self.memtable.append(part)
            self.held += len(part)
            if self.held >= self.limit:
                self.flush()

    def flush(self) -> None:
        if self.memtable:
            self.add_run(_sorted_run(np.concatenate(self.memtable)))
        self.memtable, self.held = [], 0

    def add_run(self, entries: np.ndarray) -> None:
        """Add a sorted run; runs that aren't much larger than what follows them are merged, so few stay."""
        self.runs.append([entries, None])
        while self.tiered and len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self._merge_last()

    def _merge_last(self) -> None:
        (a, _), (b, _) = self.runs[-2:]
        self.runs[-2:] = [[merge_runs(a, b), None]]

    def compact(self) -> None:
        """Merge all runs into one, small ones first; it keeps the best identifier of each digest."""
        self.flush()
        while len(self.runs) > 1:
            self._merge_last()

    def shared(self) -> "LsmIndex":
        """An index of the digests that several rows hold."""
        self.compact()
        out = LsmIndex(self.limit)
        if self.runs:
            out.add_run(self.runs[0][0][self.runs[0][0]["count"] > 1])
        return out

    def get(self, digests: np.ndarray) -> np.ndarray:
        """The entry of each digest (count 0: not there), after the filters of all runs."""
        self.flush()
        found = np.zeros(len(digests), _ENTRY)
        for run in self.runs:
            entries, bloom = run
            if bloom is None:  # made when first asked for
                bloom = run[1] = BloomFilter(len(entries))
                bloom.add(entries["digest"])
            at = np.flatnonzero(bloom.might_have(digests)) if len(entries) and len(digests) else np.zeros(0, np.int64)
            self.probed, self.rejected = self.probed + len(digests), self.rejected + len(digests) - len(at)
            place = np.minimum(np.searchsorted(entries["digest"], digests[at]), max(len(entries) - 1, 0))
            hit = entries["digest"][place] == digests[at] if len(at) else np.zeros(0, bool)
            old, new = found[at[hit]], entries[place[hit]]
            better = (old["count"] == 0) | (new["points"] > old["points"]) | (new["points"] == old["points"]) & (new["doc_id"] < old["doc_id"])
            total = old["count"] + new["count"]
            old[better] = new[better]
            old["count"] = total
            found[at[hit]] = old
        return found


def _fixed(digests) -> np.ndarray:
    """Digests as an array of 32 bytes each; numpy drops trailing zero bytes alike on both sides of a comparison."""
    return np.array(list(digests), dtype="S32")


def _cut(entries: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """A sorted run by ranges of the digests' first four bytes."""
    raw = np.frombuffer(entries["digest"].tobytes(), np.uint8).reshape(-1, 32)
    first = np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.int64)
    bounds = [0, *np.searchsorted(first, [-(-(r << 32) // ranges) for r in range(1, ranges)]).tolist(), len(entries)]
    return [(r, entries[a:b]) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]


def _flush_runs(ranges: int):
    """slice, digest, points, doc_id in; runs cut by range out, as soon as the memtable is full or the slice ends."""

    def rows(at: int, index: LsmIndex) -> pa.RecordBatch:
        out = [(r, at, part.tobytes()) for entries, _ in index.runs for r, part in _cut(entries, ranges)]
        index.runs.clear()
        return pa.RecordBatch.from_pydict({"digests": [o[0] for o in out], "slice": [o[1] for o in out], "payload": [o[2] for o in out]}, schema=pa.schema([("digests", pa.int32()), ("slice", pa.int64()), ("payload", pa.binary())]))

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = LsmIndex(tiered=False), None
        for batch in batches:
            slices, (digest, points, doc_id) = batch.column(0).to_numpy(), (_fixed(batch.column(1).to_pylist()), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            start = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(slices) else []
            for a, b in zip(start, [*start[1:], len(slices)], strict=True):
                if slices[a] != at:
                    index.flush()
                    if index.runs:
                        yield rows(at, index)
                    at = int(slices[a])
                index.put(digest[a:b], points[a:b], doc_id[a:b])
                if index.runs:
                    yield rows(at, index)
        index.flush()
        if index.runs:
            yield rows(at, index)

    return flush


def _compact_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge a digest range's runs and answer every run's own digests; only digests of several rows are answered."""
    index = LsmIndex()
    runs = [(s, np.frombuffer(p, _ENTRY)) for s, p in zip(rows["slice"], rows["payload"], strict=True)]
    for _, entries in runs:
        index.add_run(entries)
    shared, out = index.shared(), []
    for s, entries in runs:
        found = shared.get(entries["digest"])
        found = found[found["count"] > 1]
        raw = found["digest"].tobytes()
        out.append(pd.DataFrame({"slice": s, "digest": [raw[i:i + 32] for i in range(0, len(raw), 32)], "keep_id": found["doc_id"].astype(np.int64), "group_size": found["count"].astype(np.int64)}))
    return pd.concat(out).drop_duplicates(["slice", "digest"])


def normalised(text) -> F.Column:
    """The text without white space."""
    return F.translate(text, WHITE, "")


def exact_dedup(docs: DataFrame, digest=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text).

    Texts are equal when they are identical without white space. Of equal texts, the row with the
    most code points in the original text stays, then the one with the smallest doc_id. Null texts
    count as empty, and all empty texts are one group; texts of any length are digested and verified
    whole; rows without a doc_id are left out; rows that
    share doc_id and text are copies like others (each of them is ``kept`` if their id stays). An
    empty table gives an empty result; extra columns are ignored. ``digest`` maps a normalised text
    column to a 32-byte binary column (default: SHA-256).
    """
    spark = docs.sparkSession
    hashed = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    norm = normalised(F.col("text"))
    rows = texts(docs)
    seen = staged(rows.select("doc_id", F.char_length("text").cast("long").alias("points"), hashed(norm).alias("digest"), F.sha2(norm, 256).alias("text_sha256"))
                  .withColumn("slice", F.spark_partition_id().cast("long")), "dedup-digests")
    ranges = max(slots(spark), -(-seen.count() // RANGE))
    runs = seen.select("slice", "digest", "points", "doc_id").mapInArrow(_flush_runs(ranges), "digests int, slice long, payload binary")
    answers = staged(runs.groupBy("digests").applyInPandas(_compact_range, "slice long, digest binary, keep_id long, group_size long"), "dedup-index")
    found = staged(seen.join(answers, ["slice", "digest"], "left")
                   .select("doc_id", "points", "digest", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")), "dedup-found")
    wrong = _mismatches(rows, found, hashed)
    if not wrong.isEmpty():
        found = _regrouped(rows, found, wrong, hashed)
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def _mismatches(rows: DataFrame, found: DataFrame, hashed) -> DataFrame:
    """Digests with a hit whose bytes differ from those of the row that stays."""
    hits = found.where("group_size > 1 and doc_id <> keep_id").select("doc_id", "digest", "keep_id", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_size") / CHUNK)).alias("chunk"))
    keepers = found.where("group_size > 1 and doc_id = keep_id").select("doc_id", "digest", F.ceil(F.col("group_size") / CHUNK).alias("chunks")).dropDuplicates(["doc_id", "digest"])
    wanted = hits.select("doc_id", "digest", "keep_id", "chunk", F.lit(0).cast("long").alias("chunks")).unionByName(keepers.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("chunk"), "chunks"))
    bodies = rows.select("doc_id", normalised(F.col("text")).alias("body"))
    bodies = bodies.withColumn("digest", hashed(F.col("body")))
    got = staged(wanted.join(bodies, ["doc_id", "digest"]), "dedup-bodies")
    kept = got.where("chunks > 0").dropDuplicates(["keep_id", "digest"]).select("keep_id", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("body").alias("kept_body"))
    pairs = got.where("chunks = 0").join(kept, ["keep_id", "digest", "chunk"])
    return staged(pairs.where(F.col("body") != F.col("kept_body")).select("digest").distinct(), "dedup-mismatch")


def _regrouped(rows: DataFrame, found: DataFrame, wrong: DataFrame, hashed) -> DataFrame:
    """The rows of the digests in ``wrong`` grouped by their bytes."""
    bodies = rows.select("doc_id", F.char_length("text").cast("long").alias("points"), normalised(F.col("text")).alias("body")).withColumn("digest", hashed(F.col("body"))).join(wrong, "digest", "left_semi")
    best = bodies.groupBy("body").agg(F.min_by("doc_id", F.struct(-F.col("points"), "doc_id")).alias("keep_id"), F.count("*").alias("group_size"))
    redone = bodies.join(best, "body").select("doc_id", "points", "digest", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    return staged(found.join(wrong, "digest", "left_anti").select(redone.columns).unionByName(redone), "dedup-regrouped")
