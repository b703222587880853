"""N-gram Jaccard join by T-occurrence search, and its connected components.

Links are found in three steps, none of which lists the pairs of a group of copies:

1. Equal shingle sets fall together; only one document stands for each distinct set.
2. Shards send their distinct shingles, once each with a count, to the bucket of their hash, and learn
   which of them several sets have, and about how many. A set of which fewer than ``percent`` in a
   hundred shingles are shared links with nothing. The others have, in one order of all shingles from
   rare to frequent, a prefix that any set they link with shares a shingle of.
3. Sets can only meet in shingles that several sets have. So of sets that agree in all of these, the
   smallest links with whatever another of them links with: those that link with it leave the search,
   and those that don't are searched for only if it has a link at all.
4. Components by shared prefix shingles are the areas that have to be searched. Small areas are packed
   together. Others are cut into blocks of similar set sizes and bounded numbers, and each pair of blocks
   is a unit. As pairs grow with the square, areas of more than LARGE sets, which chains of shingles make,
   are first cut by their prefix shingles: all sets with a rare one are a unit (units of the same sets
   are one), and only sets that frequent ones connect are an area with blocks.
5. Each unit is one T-occurrence search: its sets become inverted lists; for each query set the short
   lists are merged, the longest ones only probed by binary search (DivideSkip), and documents that reach
   the required overlap are linked. A query skips what is linked to it already, so a dense group costs
   no more than its spanning tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_dir, slots, staged, texts, workdir
from .shingles import blocks, by_shard, distinct, shingles
from .suffix_dedup import _bucket_rows, _read_shard, _read_shard_parts, mixed

#: Documents of a block, about; shingles that a task gathers before it sends them.
BLOCK, GATHER = 256, 1 << 20
#: Sets that share a rare prefix shingle at most: they are a unit of their own.
RARE = 64
#: Sets of an area that is searched by pairs of blocks: at most LARGE / BLOCK units for each set.
LARGE = 4096
#: Bits of a shingle's hash within a set, and of what travels to its bucket (six bytes).
BITS, SENT = 52, 48
#: Cost of a probe against a merge step in the choice of the long lists.
MU = 0.0085


def required(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """The smallest intersection that links sets of these sizes: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def t_occurrence(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets numbered ``left`` (queries) and ``right`` (indexed), enough to connect all that are linked."""
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    label, out = np.arange(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(inverse, kind="stable")
    postings, ends = owner[order], np.cumsum(np.bincount(inverse, minlength=len(tokens)))
    for q in left:
        n = int(sizes[q])
        fits = (sizes[right] * 100 >= n * percent) & (n * 100 >= sizes[right] * percent) & (label[right] != label[q])
        if not fits.any():
            continue
        at = np.searchsorted(tokens, sets[q])
        at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == sets[q])]
        need = int(required(n, int(sizes[right][fits].min()), percent))
        if len(at) < need:
            continue
        begin, end = np.where(at > 0, ends[at - 1], 0), ends[at]
        by = np.argsort(end - begin, kind="stable")
        begin, end = begin[by], end[by]
        longest = int(end[-1] - begin[-1])
        long_ = min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1)))
        short = len(at) - long_
        lengths = (end - begin)[:short]
        merged = postings[np.repeat(begin[:short], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
        count = np.bincount(merged, minlength=len(right))
        hits = np.flatnonzero((count >= need - long_) & fits)
        for a, b in zip(begin[short:], end[short:], strict=True):
            if not len(hits):
                break
            places = postings[a:b]
            found = np.searchsorted(places, hits)
            count[hits] += places[np.minimum(found, b - a - 1)] == hits
        linked = hits[count[hits] >= required(n, sizes[right][hits], percent)]
        for y in linked:
            a, b = root(int(q)), root(int(right[y]))
            if a != b:
                out.append((int(q), int(right[y])))
                parent[max(a, b)] = min(a, b)
        if len(linked):
            label = np.array([root(i) for i in range(len(sets))]) if len(sets) < 64 else _roots(parent)
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    label = parent
    while (label[label] != label).any():
        label = label[label]
    return label


def _pack(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Keys of SENT bits and a byte each."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + marks.astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 7
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(-1, 6)
    return keys.view("<u8").ravel(), np.frombuffer(raw, np.uint8, n, 6 * n)


def _counted(keys: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if marks is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(marks, first) if len(keys) else marks


def prefix_tokens(h: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The shingles by which a set must be found. ``rarity``: 0 for shingles that no other set has, else rising with their number.

    None if the set has too few shared shingles to link with any other.
    """
    least = -(-percent * len(h) // 100)
    shared = np.flatnonzero(rarity > 0)
    if len(shared) < least:
        return h[:0]
    order = np.lexsort((h[shared], rarity[shared]))
    return h[shared[order[:len(shared) - least + 1]]]


def _sets(texts_: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    number, h = shingles([t.encode() for t in texts_], k)
    return distinct(number, h, len(texts_))


def _prints(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 63-bit fingerprints of each set."""
    out, ends = [], np.concatenate(([0], np.cumsum(count)))
    for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(h + salt), dtype=np.uint64)))
        out.append((mixed(sums[ends[1:]] - sums[ends[:-1]]) >> np.uint64(1)).astype(np.int64))
    return out[0], out[1]


def _describe(k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, doc_id, text in blocks(batches):
            h, count = _sets(text, k)
            one, two = _prints(h, count)
            yield pa.RecordBatch.from_pydict({"shard": shard, "doc_id": doc_id, "n_shingles": count, "print1": one, "print2": two})

    return describe


def _representatives(root: str, shard: int, seen: dict[int, np.ndarray]) -> np.ndarray:
    if shard not in seen:
        seen.clear()
        seen[shard] = np.unique(_read_shard(root, shard, np.dtype([("doc_id", "<i8"), ("print1", "<i8")])))
    return seen[shard]


def _chosen(root: str, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, doc_ids, hashes, counts) of the documents that stand for their sets."""
    seen: dict[int, np.ndarray] = {}
    for columns in blocks(batches):
        for shard, (ids, text) in by_shard(columns):
            wanted = _representatives(root, shard, seen)
            near = np.isin(np.array(ids), wanted["doc_id"]) if len(wanted) else np.zeros(len(ids), bool)
            ids, text = np.array(ids)[near], [t for t, yes in zip(text, near, strict=True) if yes]
            if not len(ids):
                continue
            h, count = _sets(text, k)
            pair = np.zeros(len(ids), wanted.dtype)
            pair["doc_id"], pair["print1"] = ids, _prints(h, count)[0]
            yes = np.isin(pair, wanted)
            keep = np.repeat(yes, count)
            yield shard, ids[yes], h[keep], count[yes]


def _send_shingles(root: str, k: int, buckets: int):
    def rows(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, count = _counted(np.concatenate(held))
        both = np.rec.fromarrays((keys, np.minimum(count, 255)), names="key,count")
        return _bucket_rows(shard, both, keys, buckets, SENT, lambda x: _pack(x["key"], x["count"]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for shard, _, h, _ in _chosen(root, k, batches):
            if held and (shard != at or size >= GATHER):
                yield rows(at, held)
                held, size = [], 0
            held.append(h >> np.uint64(BITS - SENT))
            size, at = size + len(h), shard
        if held:
            yield rows(at, held)

    return send


def _shared_shingles(rows: pd.DataFrame) -> pd.DataFrame:
    """Each shard's shingles that several sets have, with the binary logarithm of their number."""
    own = [_unpack(p) for p in rows["payload"]]
    keys, count = _counted(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))
    keys, rarity = keys[count > 1], np.floor(np.log2(np.maximum(count[count > 1], 2))).astype(np.uint8)
    out = []
    for s, (mine, _) in zip(rows["shard"], own, strict=True):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            if hit.any():
                out.append((s, _pack(mine[hit], rarity[at[hit]])))
    return pd.DataFrame(out, columns=["shard", "payload"])


_FOUND = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("tokens", pa.list_(pa.int64())), ("part", pa.int64()), ("shared", pa.int64())])


def _candidates(root: str, shared_root: str, k: int, percent: int):
    """Candidate documents with their sets, prefix shingles, and a fingerprint and number of their shared shingles."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, rarity = None, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for shard, ids, h, count in _chosen(root, k, batches):
            if shard != at:
                parts = [_unpack(p) for p in _read_shard_parts(shared_root, shard)]
                at, keys, rarity = shard, np.concatenate([p[0] for p in parts] or [keys[:0]]), np.concatenate([p[1] for p in parts] or [rarity[:0]])
                keys, first = np.unique(keys, return_index=True)
                rarity = rarity[first]
            if not len(keys):
                continue
            mine = h >> np.uint64(BITS - SENT)
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            rare = np.where(keys[place] == mine, rarity[place], 0)
            ends, out = np.cumsum(count), []
            shared = np.add.reduceat(np.append(rare > 0, False).astype(np.int64), np.append(0, ends[:-1])) if len(count) else ends
            sums = np.concatenate(([np.uint64(0)], np.cumsum(np.where(rare > 0, mixed(h + np.uint64(0x9FB21C651E98DF25)), np.uint64(0)), dtype=np.uint64)))
            part = (sums[ends] - sums[ends - count]) >> np.uint64(1)  # sums wrap at 64 bits, and so do their differences
            for d in np.flatnonzero((count > 0) & (shared * 100 >= percent * count)):
                own = slice(ends[d] - count[d], ends[d])
                out.append((ids[d], count[d], h[own].tobytes(), prefix_tokens(h[own], rare[own], percent).astype(np.int64).tolist(), int(part[d]), int(shared[d])))
            yield pa.RecordBatch.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(_FOUND)}, schema=_FOUND)

    return find


def _search(percent: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        sets = [np.frombuffer(b, "<u8") for b in rows["body"]]
        side, ids = rows["side"].to_numpy(), rows["doc_id"].to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        found = t_occurrence(sets, left, right, percent) if len(left) and len(right) else []
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["u", "v"], dtype="int64")

    return search


def _units(bodies: DataFrame, tokens: DataFrame, areas: DataFrame, percent: int) -> DataFrame:
    """unit, side (0: both, 1: query, 2: indexed), doc_id, body: what has to be searched together.

    ``bodies``: doc_id, n, body; ``tokens``: the prefix shingles that several sets have, doc_id and token;
    ``areas``: doc_id and area.
    """
    ratio = float(np.log(100 / percent) * 1.0001)
    where = staged(areas.join(bodies.select("doc_id", F.floor(F.log(F.col("n").cast("double")) / ratio).alias("step")), "doc_id"), "join-areas")
    sizes = staged(where.groupBy("area").agg(F.count("*").alias("docs")), "join-sizes")
    small = sizes.where(F.col("docs") <= RARE)
    packs = max(1, -(-(small.agg(F.sum("docs")).first()[0] or 0) // BLOCK))
    # an area may hold a third of all rows: the adaptive planner splits these joins' large partitions
    units = where.join(small.select("area"), "area").select(F.concat(F.lit("p"), F.pmod(F.xxhash64("area"), F.lit(packs))).alias("unit"), F.lit(0).alias("side"), "doc_id")
    middle = where.join(sizes.where((F.col("docs") > RARE) & (F.col("docs") <= LARGE)).select("area"), "area")
    units = units.unionByName(_block_pairs(staged(middle, "join-middle"), "m"))
    large = staged(where.join(sizes.where(F.col("docs") > LARGE).select("area"), "area").select("doc_id", "step"), "join-large")
    if not large.isEmpty():
        units = units.unionByName(_cut(large, tokens.join(large.select("doc_id"), "doc_id")))
    return units.join(bodies.select("doc_id", "body"), "doc_id")


def _cut(large: DataFrame, tokens: DataFrame) -> DataFrame:
    """unit, side, doc_id of large areas. ``large``: doc_id, step; ``tokens``: their doc_id, token."""
    use = staged(tokens.groupBy("token").agg(F.count("*").alias("docs"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum"), F.sum(F.xxhash64(F.col("doc_id") + 1, "doc_id").cast("decimal(38,0)")).alias("more"), F.min("doc_id").alias("centre")).where("docs > 1"), "join-uses")
    # a rare shingle's sets are at most RARE; shingles of the same sets (by two sums of hashes) are one unit
    kinds = use.where(F.col("docs") <= RARE).groupBy("docs", "sum", "more").agg(F.min("token").alias("token"))
    often = use.where(F.col("docs") > RARE).select("token", "docs", "centre")
    rare = tokens.join(kinds.select("token"), "token").select(F.concat(F.lit("t"), "token").alias("unit"), F.lit(0).alias("side"), "doc_id")
    areas = components(_with_uses(tokens, often).select(F.col("doc_id").alias("u"), F.col("centre").alias("v")), "join-often").select(F.col("node").alias("doc_id"), F.col("component").alias("area"))
    return rare.unionByName(_block_pairs(staged(large.join(areas, "doc_id"), "join-big"), "h"))


def _block_pairs(big: DataFrame, mark: str) -> DataFrame:
    """unit, side, doc_id: each pair of blocks of an area that can hold links. ``big``: doc_id, step, area."""
    count = staged(big.groupBy("area", "step").agg(F.ceil(F.count("*") / BLOCK).alias("m")), "join-blocks")
    own = big.join(count, ["area", "step"]).withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("m")))
    after = count.select("area", (F.col("step") - 1).alias("step"), F.col("m").alias("m_next"))
    before = count.select("area", (F.col("step") + 1).alias("step"), F.col("m").alias("m_last"))
    own = own.join(after, ["area", "step"], "left").join(before, ["area", "step"], "left")
    none = F.array().cast("array<struct<unit:string,side:int>>")

    def name(step, i, other, j):
        return F.concat_ws(":", F.lit(mark), "area", step, i, other, j)

    def upto(m):
        return F.when(m > 0, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.array().cast("array<bigint>"))

    same = F.transform(upto(F.col("m")), lambda j: F.struct(name(F.col("step"), F.least("i", j), F.col("step"), F.greatest("i", j)).alias("unit"), F.when(j == F.col("i"), 0).when(F.col("i") < j, 1).otherwise(2).alias("side")))
    up = F.transform(upto(F.coalesce("m_next", F.lit(0).cast("long"))), lambda j: F.struct(name(F.col("step"), F.col("i"), F.col("step") + 1, j).alias("unit"), F.lit(1).alias("side")))
    down = F.transform(upto(F.coalesce("m_last", F.lit(0).cast("long"))), lambda j: F.struct(name(F.col("step") - 1, j, F.col("step"), F.col("i")).alias("unit"), F.lit(2).alias("side")))
    return own.select("doc_id", F.explode(F.concat(none, same, up, down)).alias("x")).select("x.unit", "x.side", "doc_id")


def _with_uses(tokens: DataFrame, uses: DataFrame) -> DataFrame:
    """The inner join of doc_id, token rows with token, docs and more. Tokens of over a thousandth of all rows are joined apart: at most 1000."""
    total = uses.agg(F.sum("docs")).first()[0] or 0
    hot, other = uses.where(F.col("docs") * 1000 > total), uses.where(F.col("docs") * 1000 <= total)
    return tokens.join(F.broadcast(hot), "token").unionByName(tokens.join(F.broadcast(hot.select("token")), "token", "left_anti").join(other, "token"))


def _areas(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix shingles that several sets have, as doc_id and token, and doc_id and area of those sets."""
    centres = staged(tokens.groupBy("token").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"), F.count("*").alias("docs")).where("centre < last").drop("last"), "join-centres")
    found = staged(_with_uses(tokens, centres).select("doc_id", "token", "centre"), "join-tokens")
    areas = components(found.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")), "join-area")
    return found.select("doc_id", "token"), areas.select(F.col("node").alias("doc_id"), F.col("component").alias("area"))


def _links(candidates: DataFrame, percent: int) -> DataFrame:
    """u, v: links enough to connect all candidates that are linked. ``candidates``: doc_id, n, body, tokens, part, shared."""
    light = candidates.select("doc_id", "n", "part", "shared")
    first = light.groupBy("part", "shared").agg(F.min(F.struct("n", "doc_id")).alias("f"), F.count("*").alias("docs")).select("part", "shared", F.col("f.n").alias("least"), F.col("f.doc_id").alias("first"), "docs")
    # a third of all candidates may agree in their shared shingles: the adaptive planner splits this join
    agreed = staged(light.join(first.where("docs > 1"), ["part", "shared"]).where("doc_id <> first"), "join-agreed")
    near = F.col("shared") * (100 + percent) >= percent * (F.col("n") + F.col("least"))
    out = agreed.where(near).select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    far = staged(agreed.where(~near).select("doc_id", "first"), "join-far")

    def search(rows: DataFrame, name: str, among: DataFrame | None = None) -> DataFrame:
        tokens, areas = _areas(rows.select("doc_id", F.explode("tokens").alias("token")))
        if among is not None:  # only areas with one of these
            areas = areas.join(areas.join(among, "doc_id").select("area").distinct(), "area", "left_semi")
            tokens = tokens.join(areas.select("doc_id"), "doc_id", "left_semi")
        return staged(_units(rows, tokens, areas, percent).groupBy("unit").applyInPandas(_search(percent), "u long, v long"), name)

    heads = candidates.join(agreed.select("doc_id"), "doc_id", "left_anti")
    found = search(heads, "join-links")
    out = out.unionByName(found)
    if not far.isEmpty():
        ends = found.select(F.col("u").alias("first")).unionByName(found.select(F.col("v").alias("first"))).distinct()
        alive = staged(far.join(ends, "first").select("doc_id"), "join-alive")
        if not alive.isEmpty():
            both = candidates.join(agreed.select("doc_id").join(alive, "doc_id", "left_anti"), "doc_id", "left_anti")
            out = out.unionByName(search(both, "join-more", alive))
    return out


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    A document's set are the distinct shingles of k words, or its whole word sequence if it has fewer;
    documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach. Texts of any length are taken whole. Texts that are null, empty or white space have
    an empty set and link with nothing, not even with each other; equal texts (ties) link. Rows that share a doc_id are one node, so their links add up;
    rows without a doc_id are left out; an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    text_path, body_path = workdir(spark, "join-texts"), workdir(spark, "join-candidates")
    rows = staged(texts(docs).select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text"), "join-texts", text_path)
    sets = staged(rows.mapInArrow(_describe(k), "shard long, doc_id long, n_shingles long, print1 long, print2 long"), "join-sets")
    same = sets.where("n_shingles > 0").groupBy("n_shingles", "print1", "print2").agg(F.min_by(F.struct("doc_id", "shard"), F.struct("doc_id", "shard")).alias("first"))
    same = staged(same.select("n_shingles", "print1", "print2", "first.*").withColumnsRenamed({"doc_id": "stands", "shard": "at"}), "join-same")
    # equal sets may be a third of all rows: the adaptive planner splits this join's large partitions
    members = staged(sets.join(same, ["n_shingles", "print1", "print2"], "left").select("doc_id", "n_shingles", F.coalesce("stands", "doc_id").alias("stands")), "join-members")

    chosen, shared = workdir(spark, "join-chosen"), workdir(spark, "join-shared")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, own in batch.groupby("at"):
                yield pd.DataFrame({"shard": [shard], "payload": [np.stack((own["stands"], own["print1"]), axis=1).astype("<i8").tobytes()]})

    same.select("at", "stands", "print1").repartition("at").mapInPandas(packed, "shard long, payload binary").write.partitionBy("shard").parquet(chosen)
    sent = rows.mapInArrow(_send_shingles(chosen, k, 2 * slots(spark)), "bucket long, shard long, payload binary")
    sent.groupBy("bucket").applyInPandas(_shared_shingles, "shard long, payload binary").repartition("shard").write.partitionBy("shard").parquet(shared)
    candidates = staged(rows.mapInArrow(_candidates(chosen, shared, k, percent), "doc_id long, n long, body binary, tokens array<long>, part long, shared long"), "join-candidates", body_path)
    for path in (chosen, shared, text_path):
        drop_dir(spark, path)
    links = staged(_links(candidates, percent), "join-all")
    drop_dir(spark, body_path)
    # rows that share a doc_id but not their set are one node
    own = members.where("doc_id <> stands").select(F.col("doc_id").alias("u"), F.col("stands").alias("v")).join(members.groupBy("doc_id").agg(F.count_distinct("stands").alias("n")).where("n > 1").select(F.col("doc_id").alias("u")), "u")
    found = components(links.unionByName(own.select("u", "v")), "join-components").select(F.col("node").alias("stands"), "component")
    return members.join(found, "stands", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "stands")).otherwise(F.col("doc_id")).alias("component_id"))
