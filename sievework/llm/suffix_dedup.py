"""Removal of repeated passages with hash-compared suffix sorting.

Texts are bytes. A byte goes when a string of LENGTH bytes that covers it also starts in a document
with a smaller doc_id. No position is left out, yet few leave their task. Whole copies go first: of equal texts
(by SHA-256) only the one with the smallest doc_id is looked into, the others lose everything. Then:

1. Every window of LENGTH bytes has an anchor, the K-byte string in it with the smallest hash; equal
   windows have equal anchors at equal places. Each shard of documents sends its distinct anchors,
   once each, to the bucket of their hash, and learns which of them another document has too.
2. Around shared anchors the shard sends its distinct contexts (all bytes that a window with this
   anchor can hold) with the smallest doc_id that has them. In a bucket, the contexts of one anchor
   are suffix-sorted to the right and, reversed, to the left: a mergesort whose comparisons find the
   longest common extension by binary search over prefix polynomial hashes. The common extensions of
   sorted neighbours, verified byte by byte against collisions, split the contexts into classes for
   each offset of the window, and each class has a smallest doc_id.
3. Each shard reads the answers to its own contexts and marks, per document, the windows whose
   smallest doc_id is smaller than its own. A context is named by its hash; where two contexts of an
   anchor have one hash, their answers carry their bytes.

A passage that a third of all documents share is one anchor and one context per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, open_fs, slots, staged, texts, workdir

LENGTH, K = 50, 24
#: Bytes that are hashed at once, and the most of one document among them.
CHUNK, SEGMENT = 1 << 20, 1 << 19
#: Anchors that a task gathers before it sends them.
GATHER = 1 << 20
LEFT, RIGHT = LENGTH - K, LENGTH
NONE = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, x)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that its order and its high bits are as good as random; never 0."""
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.down[:len(self.sums) - length]


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of this width, by doubling."""
    have = 1
    while have * 2 <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def find_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within one segment; segments end at ``ends``."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mixed(PrefixHash(data).all(K))
    low = _slide(h, LENGTH - K + 1, np.minimum)
    for end in ends[:-1]:
        low[max(0, end - LENGTH + 1):end] = 0
    pad = np.zeros(LEFT, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), LENGTH - K + 1, np.maximum) == h)
    return at, mixed(h[at]) >> np.uint64(16)  # smallest hashes are small: mixed again, they spread evenly over buckets


def chunks(docs: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, bytes, int, int]]]]:
    """Bytes of about CHUNK, the segments' ends, and per segment (doc_id, whole text, start in it, its length).

    Consecutive segments of one document overlap by LENGTH - 1 bytes: each window is in one of them.
    """
    held, size = [], 0
    for doc_id, raw in docs:
        for start in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT - LENGTH + 1):
            n = min(SEGMENT, len(raw) - start)
            held.append((doc_id, raw, start, n))
            size += n
            if size >= CHUNK:
                yield _chunk(held)
                held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(held: list[tuple[int, bytes, int, int]]):
    data = np.frombuffer(b"".join(r[s:s + n] if n != len(r) else r for _, r, s, n in held), np.uint8)
    return data, np.cumsum([n for *_, n in held]), held


def contexts(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, bytes (LEFT before the anchor, RIGHT from it, zero outside the segment), both lengths, hash."""
    segment = np.searchsorted(ends, at, "right")
    starts = np.concatenate(([0], ends[:-1]))
    left = np.minimum(at - starts[segment], LEFT)
    right = np.minimum(ends[segment] - at, RIGHT)
    place = np.arange(-LEFT, RIGHT)
    around = data[np.clip(at[:, None] + place, 0, len(data) - 1)]
    around[(place < -left[:, None]) | (place >= right[:, None])] = 0
    up, _ = _powers(LEFT + RIGHT + 3)
    h = (around.astype(np.uint64) + np.uint64(1)) @ up[:LEFT + RIGHT] + left.astype(np.uint64) * up[-3] + right.astype(np.uint64) * up[-2]
    return segment, around, left.astype(np.uint8), right.astype(np.uint8), mixed(h)


def suffix_sort(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``rows[i, :lengths[i]]`` within each group, and each one's common prefix with its predecessor.

    ``group`` is ascending. A bottom-up mergesort over all groups at once: at each level every string
    finds its rank in the neighbouring run by binary search, comparing by longest common extensions,
    which are binary searches over prefix hashes. The common prefixes are then verified byte by byte;
    should a hash have lied, the groups are sorted by their bytes instead.
    """
    n, width = rows.shape
    lengths = lengths.astype(np.int64)
    ph, base = PrefixHash(np.ascontiguousarray(rows).ravel()), np.arange(n) * width

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(lengths[a], lengths[b])
        for _ in range(int(width).bit_length()):
            middle = (low + high + 1) >> 1
            same = ph.of(base[a], middle) == ph.of(base[b], middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a before b; equal strings by their number."""
        c = common(a, b)
        ended_a, ended_b = c >= lengths[a], c >= lengths[b]
        x, y = rows[a, np.minimum(c, width - 1)], rows[b, np.minimum(c, width - 1)]
        return np.where(ended_a & ended_b, a < b, np.where(ended_a, True, np.where(ended_b, False, x < y)))

    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    begin, count = np.repeat(first, size), np.repeat(size, size)
    order, run = np.arange(n), 1
    while n and run < size.max():
        live = np.flatnonzero(count > run)  # positions whose group has more than one run
        x, local = order[live], live - begin[live]
        mine = local // run
        start = begin[live] + (mine ^ 1) * run
        end = begin[live] + count[live]
        low = np.minimum(start, end)
        high = np.minimum(start + run, end)
        origin = low.copy()
        while (low < high).any():
            todo = np.flatnonzero(low < high)
            middle = (low[todo] + high[todo]) >> 1
            before = less(order[middle], x[todo])
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
        order[begin[live] + (mine >> 1) * 2 * run + local % run + (low - origin)] = x
        run *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        inner = group[a] == group[b]
        short = np.minimum(lengths[a], lengths[b])
        differ = (rows[a] != rows[b]) | (np.arange(width) >= short[:, None])
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        if (true != common(a, b))[inner].any():
            keys = sorted(range(n), key=lambda i: (group[i], rows[i, :lengths[i]].tobytes(), i))
            order = np.array(keys)
            a, b = order[:-1], order[1:]
            differ = (rows[a] != rows[b]) | (np.arange(width) >= np.minimum(lengths[a], lengths[b])[:, None])
            true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.where(inner, true, -1)
    if n:
        lcp[0] = -1
    return order, lcp


def smallest_owner(anchor: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per distinct context and offset 0..LEFT the smallest owner of the window that starts so far before the anchor.

    Rows are sorted by anchor. NONE where the context is too short for the window.
    """
    n, offsets = len(anchor), np.arange(LEFT + 1)
    fits = (left[:, None] >= offsets) & (right[:, None] >= LENGTH - offsets)
    out = np.where(fits, owner[:, None], NONE)
    group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]]) if n else np.zeros(0, np.int64)
    rows = np.flatnonzero(np.bincount(group)[group] > 1) if n else np.zeros(0, np.int64)
    if not len(rows):
        return out
    group, left, right, owner, around = group[rows], left[rows].astype(np.int64), right[rows].astype(np.int64), owner[rows], around[rows]
    sides = []
    for strings, lengths in ((around[:, LEFT:], right), (around[:, :LEFT][:, ::-1], left)):
        order, lcp = suffix_sort(strings, lengths, group)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sides.append((rank, lcp))
    for offset in offsets:
        ok = np.flatnonzero((left >= offset) & (right >= LENGTH - offset))
        if len(ok) < 2:
            continue
        (rank_r, lcp_r), (rank_l, lcp_l) = sides
        key = np.cumsum(lcp_r < LENGTH - offset)[rank_r[ok]] * np.int64(len(rows) + 1) + np.cumsum(lcp_l < offset)[rank_l[ok]]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        low = np.minimum.reduceat(owner[ok][order], first)
        found = np.empty(len(ok), np.int64)
        found[order] = np.repeat(low, np.diff(np.append(first, len(order))))
        out[rows[ok], offset] = found
    return out


_CONTEXT = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("owner", "<i8"), ("many", "u1"), ("left", "u1"), ("right", "u1"), ("around", "u1", (LEFT + RIGHT,))])
_ANSWER = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("owner", "<i8"), ("where", "<u4")])
#: An answer to a context whose hash another context of the anchor has too: it names the context by its bytes.
_TWIN = np.dtype([*_ANSWER.descr, ("left", "u1"), ("right", "u1"), ("around", "u1", (LEFT + RIGHT,))])
_SCHEMA = "bucket long, shard long, payload binary"
#: Bits of an anchor's hash; it travels as six bytes. The lowest bit says whether several documents have it.
ANCHOR_BITS = 48


def _bucket_rows(shard: int, values: np.ndarray, keys: np.ndarray, buckets: int, bits: int = 64, pack=np.ndarray.tobytes) -> pa.RecordBatch:
    """One row for each bucket of the sorted keys of so many bits."""
    bounds = [(b << bits) // buckets for b in range(1, buckets)]
    cut = [0, *np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]
    rows = [(b, pack(values[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "shard", "payload"])


def _pack_anchors(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_anchors(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _squeeze(rows: np.ndarray) -> bytes:
    """Contexts, field by field, compressed."""
    raw = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names)
    return len(rows).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unsqueeze(raw: bytes) -> np.ndarray:
    rows, at = np.zeros(int.from_bytes(raw[:8], "little"), _CONTEXT), 0
    data = pa.Codec("zstd").decompress(raw[8:], rows.nbytes, asbytes=True)
    for n in rows.dtype.names:
        size = rows[n].nbytes
        rows[n] = np.frombuffer(data, _CONTEXT[n].base, size // _CONTEXT[n].base.itemsize, at).reshape(rows[n].shape)
        at += size
    return rows


_COPY = np.dtype([("doc_id", "<i8"), ("print", "<i8")])


def _print(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


class _Copies:
    """Whether a document of a shard is a later copy of another."""

    def __init__(self, root: str, shard: int):
        self.prints: dict[int, set[int]] = {}
        for doc_id, value in _read_shard(root, shard, _COPY).tolist():
            self.prints.setdefault(doc_id, set()).add(value)

    def __contains__(self, doc: tuple[int, bytes]) -> bool:
        return doc[0] in self.prints and _print(doc[1]) in self.prints[doc[0]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(shard, its documents) in the order they come; a shard's documents must be used before the next."""
    import itertools

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)

    for shard, own in itertools.groupby(rows(), key=lambda r: r[0]):
        yield shard, ((r[1], r[2].encode()) for r in own)


def _read_shard_parts(root: str, shard: int) -> list:
    """What a stage has written for one shard, a buffer for each row."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = open_fs(root)
    files = fs.get_file_info(pafs.FileSelector(f"{base}/shard={shard}", allow_not_found=True))
    return [p.as_buffer() for f in files if f.path.endswith(".parquet") for p in pq.ParquetFile(fs.open_input_file(f.path)).read(["payload"]).column(0)]


def _read_shard(root: str, shard: int, kind: np.dtype) -> np.ndarray:
    """All of it as one array."""
    parts = _read_shard_parts(root, shard)
    return np.concatenate([np.frombuffer(p, kind) for p in parts]) if parts else np.zeros(0, kind)


def _send_anchors(buckets: int, copy_root: str):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, docs in _shards(batches):
            copies = _Copies(copy_root, shard)
            held, size = [], 0
            for data, ends, segments in chunks(d for d in docs if d not in copies):
                at, h = find_anchors(data, ends)
                if not len(at):
                    continue
                doc = np.array([s[0] for s in segments])[np.searchsorted(ends, at, "right")]
                held.append(_distinct(h, doc))
                size += len(held[-1])
                if size >= GATHER:
                    yield _anchor_rows(shard, held, buckets)
                    held, size = [], 0
            if held:
                yield _anchor_rows(shard, held, buckets)

    return send


def _distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct hashes, sorted; the lowest bit says whether several documents have them."""
    h = h & ~np.uint64(1)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    last = np.append(first[1:], len(h)) - 1
    return h[first] | (doc[first] != doc[last]).astype(np.uint64)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Like _distinct(), of several results of it; a hash in two of them counts as shared."""
    h = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.r_[True, (h[1:] | np.uint64(1)) != (h[:-1] | np.uint64(1))])
    many = (np.diff(np.append(first, len(h))) > 1).astype(np.uint64)
    return h[first] | many


def _anchor_rows(shard: int, held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    keys = _merged(held)
    return _bucket_rows(shard, keys, keys, buckets, ANCHOR_BITS, _pack_anchors)


def _shared_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    own = [_unpack_anchors(p) for p in rows["payload"]]
    merged = _merged(own)
    shared = merged[(merged & np.uint64(1)) == 1]
    out = [(s, x[np.isin(x | np.uint64(1), shared)] & ~np.uint64(1)) for s, x in zip(rows["shard"], own, strict=True)] if len(shared) else []
    return pd.DataFrame([(s, x.tobytes()) for s, x in out if len(x)], columns=["shard", "payload"])


def _anchored(data: np.ndarray, ends: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (lowest bit 0) of the anchors that are in ``shared``."""
    at, h = find_anchors(data, ends)
    h = h & ~np.uint64(1)
    if not len(shared) or not len(at):
        return at[:0], h[:0]
    hit = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
    return at[hit], h[hit]


def _send_contexts(buckets: int, root: str, copy_root: str):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, docs in _shards(batches):
            shared, copies = np.unique(_read_shard(root, shard, np.dtype("<u8"))), _Copies(copy_root, shard)
            held, size = [], 0
            for data, ends, segments in chunks(d for d in docs if d not in copies):
                at, h = _anchored(data, ends, shared)
                if not len(at):
                    continue
                segment, around, left, right, key = contexts(data, ends, at)
                rows = np.zeros(len(at), _CONTEXT)
                rows["anchor"], rows["hash"], rows["owner"] = h, key, np.array([s[0] for s in segments])[segment]
                rows["left"], rows["right"], rows["around"] = left, right, around
                held.append(_best(rows))
                size += len(held[-1])
                if size >= GATHER >> 2:
                    held = [_best(np.concatenate(held))]
                    size = len(held[0])
                    if size >= GATHER >> 3:
                        yield _bucket_rows(shard, held[0], held[0]["anchor"], buckets, ANCHOR_BITS, _squeeze)
                        held, size = [], 0
            if held:
                rows = _best(np.concatenate(held))
                yield _bucket_rows(shard, rows, rows["anchor"], buckets, ANCHOR_BITS, _squeeze)

    return send


def _best(rows: np.ndarray) -> np.ndarray:
    """One row for each context, sorted by anchor and hash: the smallest owner, and whether there are several.

    Equal hashes are verified byte by byte: contexts that share a hash only stay rows of their own, next to each other.
    """
    if not len(rows):
        return rows
    order = np.lexsort((rows["owner"], rows["hash"], rows["anchor"]))
    first = _starts(rows, order, "anchor", "hash")
    again = np.setdiff1d(np.arange(len(rows)), first, assume_unique=True)
    if any((rows[n][order[again]] != rows[n][order[again - 1]]).any() for n in ("left", "right", "around")):
        content = np.unique(_content(rows), axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((rows["owner"], content, rows["hash"], rows["anchor"]))
        first = np.union1d(_starts(rows, order, "anchor", "hash"), np.flatnonzero(np.r_[True, np.diff(content[order]) != 0]))
    d = rows["owner"][order]
    last = np.append(first[1:], len(rows)) - 1
    out = rows[order[first]]
    out["many"] = np.maximum(np.maximum.reduceat(rows["many"][order], first), d[first] != d[last])
    return out


def _starts(rows: np.ndarray, order: np.ndarray, *fields: str) -> np.ndarray:
    """Places in this order where one of the fields changes."""
    change = np.zeros(len(order), bool)
    change[0] = True
    for n in fields:
        value = rows[n][order]
        change[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(change)


def _content(rows: np.ndarray) -> np.ndarray:
    """All bytes that make a context, a row each: both lengths and what is around the anchor."""
    return np.column_stack((rows["left"], rows["right"], rows["around"]))


def _answer_contexts(rows: pd.DataFrame) -> pd.DataFrame:
    own = [_unsqueeze(p) for p in rows["payload"]]
    whole = _best(np.concatenate(own))
    low = smallest_owner(whole["anchor"], whole["around"], whole["left"], whole["right"], whole["owner"])
    like_next = (whole["anchor"][1:] == whole["anchor"][:-1]) & (whole["hash"][1:] == whole["hash"][:-1])
    twin = np.r_[False, like_next] | np.r_[like_next, False]
    useful = (whole["many"] > 0) | (low < whole["owner"][:, None]).any(axis=1)
    whole, low, twin = whole[useful], low[useful], twin[useful]
    # a row for each context and smallest owner; nearly always one for a context
    answers, of, left = [], [], low != NONE
    while left.any():
        rest = np.where(left, low, NONE)
        owner = rest.min(axis=1)
        now = left & (low == owner[:, None])
        some = np.flatnonzero(left.any(axis=1))
        part = np.zeros(len(some), _ANSWER)
        part["anchor"], part["hash"], part["owner"] = whole["anchor"][some], whole["hash"][some], owner[some]
        part["where"] = now[some] @ (np.uint32(1) << np.arange(LEFT + 1, dtype=np.uint32))
        answers.append(part)
        of.append(some)
        left &= ~now
    if not answers:
        return pd.DataFrame(columns=["shard", "payload"])
    answers, of = np.concatenate(answers), np.concatenate(of)
    keys = _keys(answers)
    order = np.argsort(keys, kind="stable")
    names = keys[order]
    out = []
    for s, x in zip(rows["shard"], own, strict=True):
        mine = np.unique(_keys(x))
        a, b = np.searchsorted(names, mine, "left"), np.searchsorted(names, mine, "right")
        pick = order[np.repeat(a, b - a) + _within(b - a)]
        apart = twin[of[pick]]
        if not apart.all():
            out.append((s, b"\0" + answers[pick[~apart]].tobytes()))
        if apart.any():
            rows_of = np.zeros(int(apart.sum()), _TWIN)
            for n in _TWIN.names:
                rows_of[n] = answers[n][pick[apart]] if n in _ANSWER.names else whole[n][of[pick[apart]]]
            out.append((s, b"\1" + rows_of.tobytes()))
    return pd.DataFrame(out, columns=["shard", "payload"])


def _read_answers(root: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Answers to a shard, sorted by their keys; for each the row of its context's content (-1: its hash tells it); these contents."""
    parts = _read_shard_parts(root, shard)
    plain, named = ([np.frombuffer(p, kind, offset=1) for p in parts if p[0] == mark] for mark, kind in ((0, _ANSWER), (1, _TWIN)))
    plain = np.unique(np.concatenate(plain)) if plain else np.zeros(0, _ANSWER)
    named = np.concatenate(named) if named else np.zeros(0, _TWIN)
    answers = np.zeros(len(plain) + len(named), _ANSWER)
    answers[:len(plain)] = plain
    for n in _ANSWER.names:
        answers[n][len(plain):] = named[n]
    twin = np.r_[np.full(len(plain), -1), np.arange(len(named))]
    order = np.argsort(_keys(answers), kind="stable")
    return answers[order], twin[order], _content(named)


def _keys(rows: np.ndarray) -> np.ndarray:
    return rows["anchor"] ^ (rows["hash"] << np.uint64(1))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _mark(copy_root: str, answer_root: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, docs in _shards(batches):
            copies, gone = _Copies(copy_root, shard), []

            def rest(docs=docs, copies=copies, gone=gone):
                for doc in docs:
                    if doc in copies:
                        gone.append((doc[0], *_removed(doc[1], [np.arange(max(0, len(doc[1]) - LENGTH + 1))])))
                    else:
                        yield doc

            answers, twin, content = _read_answers(answer_root, shard)
            keys, shared = _keys(answers), np.unique(answers["anchor"])
            starts: dict[int, list[np.ndarray]] = {}
            for data, ends, segments in chunks(rest()):
                at, h = _anchored(data, ends, shared)
                if len(at):
                    segment, around, left, right, key = contexts(data, ends, at)
                    name = h ^ (key << np.uint64(1))
                    a, b = np.searchsorted(keys, name, "left"), np.searchsorted(keys, name, "right")
                    hit = np.repeat(np.arange(len(at)), b - a)
                    pick = np.repeat(a, b - a) + _within(b - a)
                    got = answers[pick]
                    doc = np.array([s[0] for s in segments])[segment[hit]]
                    good = (got["owner"] < doc) & (got["anchor"] == h[hit]) & (got["hash"] == key[hit])
                    for i in np.flatnonzero(good & (twin[pick] >= 0)):
                        good[i] = (content[twin[pick[i]]] == np.r_[left[hit[i]], right[hit[i]], around[hit[i]]]).all()
                    hit, where = hit[good], got["where"][good]
                    which, offset = np.nonzero((where[:, None] >> np.arange(LEFT + 1, dtype=np.uint32)) & 1)
                    hit = hit[which]
                    first = np.concatenate(([0], ends[:-1]))
                    place = at[hit] - offset - first[segment[hit]] + np.array([s[2] for s in segments])[segment[hit]]
                    by = np.argsort(segment[hit], kind="stable")
                    cut = np.searchsorted(segment[hit][by], np.arange(len(segments) + 1))
                    for i in np.flatnonzero(np.diff(cut)):
                        starts.setdefault(id(segments[i][1]), []).append(place[by[cut[i]:cut[i + 1]]])
                out = []
                for doc_id, raw, start, n in segments:
                    if start + n >= len(raw):
                        out.append((doc_id, *_removed(raw, starts.pop(id(raw), None))))
                yield _result(out + gone)
                gone.clear()
            yield _result(gone)

    return mark


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(_RESULT.names)}, schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _removed(raw: bytes, starts: list[np.ndarray] | None) -> tuple[int, int, int, str, list[int]]:
    """Length, removed bytes, removed runs, digest of what is left, and the runs' bounds."""
    at = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    if not len(at):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []
    new = np.flatnonzero(np.r_[True, np.diff(at) > LENGTH])
    begin, end = at[new], at[np.append(new[1:], len(at)) - 1] + LENGTH
    digest, last = hashlib.sha256(), 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        digest.update(raw[last:a])
        last = b
    digest.update(raw[last:])
    return len(raw), int((end - begin).sum()), len(begin), digest.hexdigest(), np.stack((begin, end), axis=1).ravel().tolist()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for each row of ``docs`` (doc_id, text).

    ``spans`` are the bounds of the removed runs: begin, end, begin, end, ... in bytes. Null texts count
    as empty; texts of fewer than 50 bytes lose nothing; texts of any length are handled whole, in
    overlapping segments; rows without a doc_id are left out; rows that share a doc_id (ties) never remove
    from each other, for neither has the smaller one; an empty table gives an empty result; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    buckets = 2 * slots(spark)
    rows = staged(texts(docs).select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text"), "suffix-texts")
    copies, shared, answers = (workdir(spark, f"suffix-{n}") for n in ("copies", "shared", "answers"))
    _later_copies(rows).repartition("shard").write.partitionBy("shard").parquet(copies)
    sent = rows.mapInArrow(_send_anchors(buckets, copies), _SCHEMA)
    sent.groupBy("bucket").applyInPandas(_shared_anchors, "shard long, payload binary").repartition("shard").write.partitionBy("shard").parquet(shared)
    sent = rows.mapInArrow(_send_contexts(buckets, shared, copies), _SCHEMA)
    sent.groupBy("bucket").applyInPandas(_answer_contexts, "shard long, payload binary").repartition("shard").write.partitionBy("shard").parquet(answers)
    drop_dir(spark, shared)
    return rows.mapInArrow(_mark(copies, answers), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def _later_copies(rows: DataFrame) -> DataFrame:
    """shard, payload: doc_id and the head of the digest of each document whose whole text a smaller doc_id has."""
    seen = rows.select("shard", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    # a row for each digest and shard: no digest has more rows than there are shards
    held = staged(seen.groupBy("digest", "shard").agg(F.collect_list("doc_id").alias("ids")), "suffix-held")
    first = held.groupBy("digest").agg(F.min(F.array_min("ids")).alias("first"), F.sum(F.size("ids")).alias("n")).where("n > 1").select("digest", "first")
    later = held.join(first, "digest").select("shard", F.explode(F.filter("ids", lambda i: i > F.col("first"))).alias("doc_id"), "digest")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), _COPY)
            out["doc_id"] = batch["doc_id"]
            out["print"] = [int.from_bytes(d[:8], "big", signed=True) for d in batch["digest"]]
            yield pd.DataFrame([(s, out[at].tobytes()) for s, at in batch.groupby("shard").indices.items()], columns=["shard", "payload"])

    return later.mapInPandas(pack, "shard long, payload binary")
