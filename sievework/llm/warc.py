"""WARC archives with a two-level capture index.

Writing: one record for each page, gzip member by gzip member, in files of bounded size. Of pages
with equal payloads the first is a response, the others are revisits that name it. Indexing: every
record's reversed-host URL key is sorted over the cluster into index files; a file holds compressed
blocks of lines and, at its end, a sparse directory of the blocks' first keys. Looking up: a key finds
its index file among the files' first keys, its block by binary search in that file's directory, its
line by binary search in the block, and then its record by a range read of the archive, nearby ranges
of one archive together.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, slots, staged, workdir

#: Payloads of fewer bytes are never made revisits.
LEAST_PAYLOAD = 100
#: Lines in a block of the index; bytes after which another archive is begun; gap that one read spans.
BLOCK_LINES, ARCHIVE_BYTES, READ_GAP = 512, 1 << 30, 1 << 16
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_TAIL = "<QQ8s"
_MAGIC = b"SWCDX001"


def surt(url: str | None) -> str:
    """The reversed-host key of an URL: ``http://m.example.com/a?b#c`` -> ``com,example,m)/a?b``. Null: empty."""
    if not url:
        return ""
    m = _URL.match(url)
    if not m:
        return ")" + url.split("#")[0]
    host, _, port = m[1].lower().partition(":")
    key = ",".join(reversed(host.split(".")))
    return f"{key}{':' + port if port and port not in ('80', '443') else ''}){m[2] or '/'}"


def entry_key(url: str | None, page_id: int) -> str:
    """What the index is sorted by: the URL key, then the page's number. No control character, so a line stays a line."""
    return re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", surt(url)) + f" {page_id + (1 << 63):020d}"


def _name(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, without compression. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {re.sub(chr(92) + 's', lambda c: f'%{ord(c[0]):02X}', url or '')}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload an earlier page has; pages: page_id, html."""
    seen = pages.select("page_id", F.sha2("html", 256).alias("digest")).where(F.octet_length("html") >= LEAST_PAYLOAD)
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    # a third of all rows may share a digest: the adaptive planner splits this join's large partitions
    return seen.join(first, "digest").where("page_id <> refers_to").dropDuplicates(["page_id", "digest"])


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write a record for each row (page_id, url, html); returns the captures: entry, file, offset, length.

    A null html is an empty payload, a null url an empty key; rows without a page_id are left out;
    rows that repeat a page_id get a record each. An archive has its task attempt's name and belongs
    to the collection only by its captures, so lost attempts leave nothing visible.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    again = staged(revisits(rows), "warc-revisits")
    rows = rows.withColumn("digest", F.sha2("html", 256)).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(root)
        fs.create_dir(base, recursive=True)
        context, number, out, at = TaskContext.get(), 0, None, 0
        for batch in batches:
            made = []
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:03d}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, html.encode(), refers_to)) + packer.flush()
                    out.write(raw)
                    made.append((entry_key(url, page_id), name, at, len(raw)))
                    at += len(raw)
            yield pa.RecordBatch.from_pydict({k: [m[i] for m in made] for i, k in enumerate(("entry", "file", "offset", "length"))}, schema=pa.schema([("entry", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return staged(rows.mapInArrow(write, "entry string, file string, offset long, length long"), "warc-captures")


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Sort the captures into index files; returns the files: first, path, size, lines."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(root)
        context, out, held, directory, at, lines, first = TaskContext.get(), None, [], [], 0, 0, None

        def flush() -> int:
            raw = zlib.compress("\n".join(held).encode(), 6)
            out.write(raw)
            directory.append((held[0].split("\t", 1)[0], at, len(raw)))
            held.clear()
            return at + len(raw)

        for batch in batches:
            for entry, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, first = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.cdx", entry
                    out = fs.open_output_stream(path, compression=None)
                held.append(f"{entry}\t{file}\t{offset}\t{length}")
                lines += 1
                if len(held) >= BLOCK_LINES:
                    at = flush()
        if out is not None:
            if held:
                at = flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.write(struct.pack(_TAIL, at, len(raw), _MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "path": [path], "size": [at + len(raw) + struct.calcsize(_TAIL)], "lines": [lines]})

    ordered = captures.repartitionByRange("entry").sortWithinPartitions("entry", "file", "offset")
    return staged(ordered.mapInArrow(write, "first string, path string, size long, lines long"), "warc-index")


class IndexFile:
    """Binary search in one index file: directory first, then a block, one block kept."""

    def __init__(self, source, size: int):
        self.source, self.at, self.lines, self.keys = source, -1, [], []
        source.seek(size - struct.calcsize(_TAIL))
        start, length, magic = struct.unpack(_TAIL, source.read(struct.calcsize(_TAIL)))
        if magic != _MAGIC:
            raise ValueError("not a capture index")
        source.seek(start)
        self.directory = json.loads(zlib.decompress(source.read(length)))
        self.firsts = [d[0].encode() for d in self.directory]

    def _load(self, block: int) -> None:
        if block != self.at:
            _, start, length = self.directory[block]
            self.source.seek(start)
            self.lines = zlib.decompress(self.source.read(length)).decode().split("\n")
            self.keys = [x.split("\t", 1)[0].encode() for x in self.lines]
            self.at = block

    def find(self, entry: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; equal keys may run over several blocks."""
        key, out = entry.encode(), []
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.firsts) and self.firsts[block] <= key:
            self._load(block)
            a = bisect.bisect_left(self.keys, key)
            while a < len(self.keys) and self.keys[a] == key:
                _, file, offset, length = self.lines[a].split("\t")
                out.append((file, int(offset), int(length)))
                a += 1
            block += 1
        return out


def lookup(wanted: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """Captures (file, offset, length) of the wanted (page_id, url) rows; each capture once."""
    # one row for each index file: the upper level, as many as the sort had partitions
    files = sorted(((r["first"].encode(), r["path"], r["size"]) for r in index.collect()))
    firsts = [f[0] for f in files]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [entry_key(u, int(p)) for p, u in zip(batch["page_id"], batch["url"], strict=True)]
            yield pd.DataFrame({"entry": keys, "number": [max(0, bisect.bisect_right(firsts, k.encode()) - 1) for k in keys]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(root)
        at, source, index_file = None, None, None
        for batch in batches:
            found = []
            for entry, number in zip(batch["entry"], batch["number"], strict=True):
                if number != at:
                    if source is not None:
                        source.close()
                    source = fs.open_input_file(files[number][1])
                    at, index_file = number, IndexFile(source, files[number][2])
                found += index_file.find(entry)
            yield pd.DataFrame(found, columns=["file", "offset", "length"])

    if not files:
        return wanted.sparkSession.createDataFrame([], "file string, offset long, length long")
    routed = wanted.select("page_id", "url").mapInPandas(route, "entry string, number int").dropDuplicates(["entry", "number"])
    ordered = routed.repartition(slots(wanted.sparkSession), "number").sortWithinPartitions("number", "entry")
    return ordered.mapInPandas(search, "file string, offset long, length long")


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """The records at (file, offset, length): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(root)
        name, source = None, None
        for batch in batches:
            rows, a = list(zip(batch["file"], batch["offset"], batch["length"], strict=True)), 0
            while a < len(rows):
                file, start, b, stop = rows[a][0], rows[a][1], a, rows[a][1]
                while b < len(rows) and rows[b][0] == file and rows[b][1] <= stop + READ_GAP and rows[b][1] - start < 1 << 22:
                    stop, b = max(stop, rows[b][1] + rows[b][2]), b + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(file)
                source.seek(start)
                raw, out = source.read(stop - start), []
                for _, offset, length in rows[a:b]:
                    fields, http, payload = parse(zlib.decompress(raw[offset - start:offset - start + length], 31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} is damaged at {offset}")
                    refers = fields.get("WARC-Refers-To")
                    out.append((int(fields["WARC-Record-ID"][10:-1]), fields["WARC-Target-URI"], int(http["Content-Length"]) if kind == "revisit" else len(payload), digest, kind, int(refers[10:-1]) if refers else None, payload))
                frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                frame["refers_to"] = frame["refers_to"].astype("Int64")
                yield frame
                a = b

    ordered = captures.repartition(slots(captures.sparkSession), "file").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write archives and index for ``pages`` (page_id, url, html): captures, index files, folder."""
    root = root or workdir(pages.sparkSession, "warc")
    captures = write_archives(pages, root + "/archives")
    return captures, write_index(captures, root + "/index"), root


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, look every page up and read it back; an empty table gives an empty result."""
    _, index, root = archive(pages)
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).where("page_id is not null")
    return read_records(staged(lookup(wanted, index, root), "warc-found"), root)
