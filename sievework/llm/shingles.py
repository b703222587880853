"""Word shingles of many texts at once, as 64-bit hashes.

Words are maximal runs of bytes other than space, tab to carriage return, with A-Z in lower case.
A shingle is hashed from its words' hashes, so equal shingles have equal hashes whatever text they
are in; different ones collide with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .suffix_dedup import PrefixHash, mixed

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(1, 65)], np.uint64)
#: Bytes that are hashed at once.
PIECE = 1 << 20


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([0], (~_WHITE[data]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, mixed(PrefixHash(data).of(start, end - start) + (end - start).astype(np.uint64))


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out += words[i:len(words) - k + 1 + i] * _STEPS[i]
    return mixed(out)


def shingles(raws: list[bytes], k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every shingle of k words, in order.

    With ``short``, a text of fewer than k words (but some) has its whole sequence as one shingle.
    """
    numbers, hashes = [], []
    for group in _grouped(raws):
        if len(group) == 1 and len(raws[group[0]]) > PIECE:
            words = np.concatenate([word_hashes(p)[1] for p in _pieces(raws[group[0]])])
            first = np.zeros(len(words), np.int64)
        else:
            sizes = np.array([len(raws[i]) + 1 for i in group])
            start, words = word_hashes(b" ".join([raws[i] for i in group]))
            first = np.searchsorted(np.cumsum(sizes), start, "right")
        count = np.bincount(first, minlength=len(group)) if len(group) else np.zeros(0, np.int64)
        if len(words) >= k:
            h = combined(words, k)
            whole = first[:len(h)] == first[k - 1:]
            numbers.append(np.array(group)[first[:len(h)][whole]])
            hashes.append(h[whole])
        if short:
            ends = np.cumsum(count)
            for i in np.flatnonzero((count > 0) & (count < k)):
                numbers.append(np.array([group[i]]))
                hashes.append(mixed(combined(words[ends[i] - count[i]:ends[i]], int(count[i])) + np.uint64(count[i])))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, h = np.concatenate(numbers), np.concatenate(hashes)
    if short:
        order = np.argsort(n, kind="stable")
        n, h = n[order], h[order]
    return n, h


def _grouped(raws: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts in groups of about PIECE bytes; a larger text alone."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        if held and size + len(raw) > PIECE:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(raw)
    if held:
        yield held


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut between words."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _WHITE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def distinct(number: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and how many it has. ``texts`` is below 4096; 52 bits of a hash stay."""
    key = np.sort((number.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & np.uint64((1 << 52) - 1), np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=texts)


def release() -> None:
    """Give what this worker has freed back to the machine: the allocator keeps it, and workers live on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[list[list]]:
    """The columns of at most ``rows`` rows of a batch at a time, as lists."""
    for at in range(0, batch.num_rows, rows):
        yield [c.to_pylist() for c in batch.slice(at, rows).columns]


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[list[list]]:
    """The parts of all batches of a task; memory is released at its end."""
    for batch in batches:
        yield from parts(batch, rows)
    release()


def by_shard(columns: list[list]) -> Iterator[tuple[int, list[list]]]:
    """Runs of equal values in the first column, with the other columns."""
    at = 0
    for shard, run in itertools.groupby(columns[0]):
        n = len(list(run))
        yield shard, [c[at:at + n] for c in columns[1:]]
        at += n
