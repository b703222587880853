"""Token-id output: fixed-width bit packing in binary files, and reading them back.

A text is cut at ASCII white space, at which the tokenizer's own splitting always cuts too, and each
distinct piece is encoded once per worker. The ids of a document, with an end id, go into a file of
packed blocks: every id takes the minimum number of bits that the vocabulary needs, each block starts
on a byte, and block offsets and document ends follow in a footer, so any range of ids is read with
one seek and unpacked by numpy.

File layout (little endian): ``magic 8 bytes | packed blocks | block offsets u64[] | doc ends u64[] |
doc ids i64[] | footer``; footer = bits u32, block_ids u32, n_blocks u64, n_docs u64, n_ids u64, magic.
A file is written under a name of its own for each task attempt and becomes part of the output only
by its row in the manifest, so a repeated or lost attempt leaves nothing visible.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, open_fs, slots, staged, texts, workdir
from .shingles import release

MAGIC = b"SWTOKEN1"
FOOTER = struct.Struct("<IIQQQ8s")
#: Ids in a block.
BLOCK_IDS = 65_536
#: Pieces that a worker remembers; beyond, it starts anew (a single batch may hold more).
CACHE = 400_000
#: Marks that may be cut from the end of a piece after a letter or digit: there the tokenizer always cuts too.
TAIL = ".,!%&*$#;:?"


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary of this size needs."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits as consecutive little-endian bit fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of pack()'s bytes, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    fields = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (fields.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype("<u4")


class TokenWriter:
    """Appends documents to one packed file."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.out.write(MAGIC)
        self.at, self.n_ids, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.offsets, self.ends, self.ids = [], [], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.ids.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            raw = pack(ids[a:min(a + self.block_ids, whole)], self.bits)
            self.out.write(raw)
            self.offsets.append(self.at)
            self.at += len(raw)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for kind, values in (("<u8", self.offsets), ("<u8", self.ends), ("<i8", self.ids)):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block_ids, len(self.offsets), len(self.ends), self.n_ids, MAGIC))


class TokenReader:
    """Random access to a packed file: whole documents or any range of ids."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        self.bits, self.block_ids, blocks, docs, self.n_ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        start = size - FOOTER.size - 8 * (blocks + 2 * docs)
        source.seek(start)
        self.offsets = np.append(np.frombuffer(source.read(8 * blocks), "<u8"), np.uint64(start)).astype(np.int64)
        self.ends = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(source.read(8 * docs), "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, out = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            out.append(unpack(raw[int(self.offsets[b]) - base:int(self.offsets[b + 1]) - base], self.bits, n))
        return np.concatenate(out)[start - first * self.block_ids:stop - first * self.block_ids]

    def documents(self, per_read: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of every document in order, about per_read ids a read."""
        starts, at = np.append(0, self.ends), 0
        while at < len(self.ends):
            stop = max(at + 1, int(np.searchsorted(self.ends, starts[at] + per_read, "right")))
            ids = self.ids(int(starts[at]), int(self.ends[stop - 1]))
            for d in range(at, stop):
                yield int(self.doc_ids[d]), ids[starts[d] - starts[at]:self.ends[d] - starts[at]]
            at = stop


# The normaliser, splitter and model setting under which a text's pieces can be encoded apart.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_white_space(file: dict) -> bool:
    """Whether a tokenizer's file is of the kind whose pieces between white space can be encoded apart.

    Its added tokens must be such that no word with a tail of marks can hold one.
    """
    def apart(token: dict) -> bool:
        return not (token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"] or any(c.isspace() for c in token["content"]) or token["content"][0].isalpha() or token["content"][0] in TAIL)

    return file["normalizer"] == NORMALISER and file["pre_tokenizer"] == SPLITTER and file["model"]["type"] == "BPE" and not file["model"].get("dropout") and file["post_processor"] is None and all(map(apart, file["added_tokens"]))


class PieceEncoder:
    """Encodes texts piece by piece, remembering the pieces' ids as little-endian bytes.

    Words whose lower case is of ASCII and Latin-1 letters are what the tokenizer's normaliser would
    only put in lower case and its splitter would not split, so in lower case they go straight to its
    model, byte for byte; all other pieces go through the whole tokenizer, each alone. Special tokens
    in a text are what the tokenizer makes of them. A file whose normaliser or splitter isn't the one
    this relies on (``by_pieces`` False) has every text encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = splits_at_white_space(json.loads(self.tokenizer.to_str()))
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.simple = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _alone(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]

    def _word(self, low: str) -> bytes | None:
        """The ids of a word in lower case; None if it isn't of the plain letters."""
        if not low.isascii():
            if not self.simple.keys() >= set(map(ord, low)):
                return None
            low = low.translate(self.simple)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(low)]).tobytes()

    def learn(self, new: Iterable[str]) -> None:
        """Remember the ids of new pieces: a word and a tail of marks apart, other pieces whole."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.marks) > CACHE // 4:
            self.marks.clear()
        pieces, words, marks, other, word = self.pieces, self.words, self.marks, [], self._word
        for piece in new:
            stem = piece.rstrip(TAIL)
            ids = None
            if stem.isalpha():
                low = stem.lower()
                ids = words.get(low)
                if ids is None and (ids := word(low)) is not None:
                    words[low] = ids
            if ids is None:
                other.append(piece)
                continue
            if len(stem) < len(piece):
                tail = piece[len(stem):]
                if tail not in marks:
                    marks[tail] = self._alone([tail])[0]
                ids += marks[tail]
            pieces[piece] = ids
        pieces.update(zip(other, self._alone(other), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, four bytes each."""
        if not self.by_pieces:
            return self._alone(texts)
        split = [_split(t) for t in texts]
        known = self.pieces
        known[""] = b""
        new = set(itertools.chain.from_iterable(split)) - known.keys()
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(itertools.chain.from_iterable(split))
        self.learn(new)
        known[""] = b""
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


def _split(text: str) -> list[str]:
    """The text's pieces between white space, and empty ones."""
    for c in WHITE[1:]:
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_MANIFEST = "path string, size long, first_doc long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode doc_id, text and write packed files in ascending doc_id order; returns the manifest.

    The manifest has a row for each file: path, size, first_doc, n_docs, n_ids. Files hold ascending,
    disjoint ranges of doc_id. A null text counts as empty (its only id is the end id); texts of any
    length are encoded whole; rows without a doc_id are left out; rows that share a doc_id (ties) lie
    next to each other, ordered by text; an empty table gives an empty manifest; extra columns are
    ignored. ``tokenizer`` is a tokenizers-library file that every worker can read, ``end_id`` is
    appended to each document.
    """
    spark = docs.sparkSession
    root = path or workdir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, first = None, None
        fs, base = open_fs(root)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                enc = encoder(tokenizer)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_many(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        context = TaskContext.get()
                        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tok"
                        fs.create_dir(base, recursive=True)
                        out, first = fs.open_output_stream(name), doc_id
                        writer = TokenWriter(out, width(max(enc.vocabulary, end_id + 1)), block_ids)
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [fs.get_file_info(name).size], "first_doc": [first], "n_docs": [len(writer.ends)], "n_ids": [writer.n_ids]})
        release()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, root: str | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    scheme = root or workdir(spark, "x")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(scheme)
        for batch in batches:
            for name, size, base in zip(batch["path"], batch["size"], batch["base"], strict=True):
                with fs.open_input_file(name) as source:
                    reader = TokenReader(source, int(size))
                    lengths = np.diff(np.append(0, reader.ends))
                    crc = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader.documents()), np.int64, len(lengths))
                    for a in range(0, len(lengths), 10_000):
                        b = slice(a, a + 10_000)
                        yield pd.DataFrame({"doc_id": reader.doc_ids[b], "start": int(base) + reader.ends[b] - lengths[b], "n_tokens": lengths[b], "ids_crc32": crc[b]})

    # one row for each file: the running total needs no more than the manifest
    before = F.sum("n_ids").over(Window.orderBy("first_doc").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("path", "size", "base").repartition(slots(spark), "path")
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """write_tokens() and read_tokens() in turn."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id))
