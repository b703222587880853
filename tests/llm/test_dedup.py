import hashlib
import re

from pyspark.sql import functions as F

from sievework.llm import suffix_dedup as suffix_dedup_module
from sievework.llm.exact_dedup import LsmIndex, _sorted_run, exact_dedup, merge_runs
from sievework.llm.jaccard_join import jaccard_components, prefix_tokens, required, t_occurrence
from sievework.llm.suffix_dedup import suffix_dedup, suffix_sort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from . import fixtures


def _exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    out = []
    for body, members in groups.items():
        keep = min(members)[1]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest()) for _, d in members]
    return sorted(out)


def _plain(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").where("doc_id is not null").collect()]


def test_exact_dedup(spark):
    docs = fixtures.docs(spark)
    assert sorted(map(tuple, exact_dedup(docs).collect())) == _exact(_plain(docs))
    assert exact_dedup(fixtures.empty(spark)).collect() == []


def test_exact_dedup_verifies_bytes(spark):
    docs = fixtures.docs(spark)
    weak = exact_dedup(docs, lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256)))
    assert sorted(map(tuple, weak.collect())) == _exact(_plain(docs))


def test_lsm_index():
    index, digests = LsmIndex(memtable=8, tiered=False), np.array([hashlib.sha256(bytes([i % 40])).digest() for i in range(100)], "S32")
    index.put(digests, np.arange(100) % 3, np.arange(100))
    assert len(index.runs) > 3
    before = index.get(digests)
    index.compact()
    after = index.get(digests)
    assert len(index.runs) == 1 and (before == after).all()
    for i in range(40):
        same = [j for j in range(100) if j % 40 == i]
        assert after[i]["doc_id"] == min(same, key=lambda j: (-(j % 3), j)) and after[i]["count"] == len(same)
    assert index.get(np.array([b"\x07" * 32], "S32"))[0]["count"] == 0


def test_lsm_index_merges_runs_and_rejects_by_filter():
    digests = np.array([hashlib.sha256(str(i if i % 50 else 0).encode()).digest() for i in range(5000)], "S32")
    index = LsmIndex(memtable=64)
    index.put(digests, np.ones(5000, np.int64), np.arange(5000))
    assert 1 < len(index.runs) <= 14, "runs of like sizes are merged"
    shared = index.shared()
    found = shared.get(digests)
    assert len(shared.runs[0][0]) == 1 and (found["count"] > 1).sum() == 100 and (found["doc_id"][found["count"] > 1] == 0).all()
    assert shared.probed == 5000 and shared.rejected > 4000, "the filter rejects digests that only one row has"
    whole = _sorted_run(np.concatenate([r for r, _ in index.runs]))
    half = len(whole) // 2
    assert (merge_runs(whole[:half], whole[half:]) == whole).all() and (merge_runs(whole, whole)["count"] == 2 * whole["count"]).all()


def _removed(rows):
    first, out = {}, []
    for d in sorted({d for d, _ in rows}):
        new = []
        for t in (t for i, t in rows if i == d):
            raw = (t or "").encode()
            gone = bytearray(len(raw))
            for p in range(len(raw) - 49):
                if raw[p:p + 50] in first:
                    gone[p:p + 50] = b"\1" * 50
                else:
                    new.append(raw[p:p + 50])
            kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
            out.append((d, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        first.update(dict.fromkeys(new))
    return sorted(out)


def test_suffix_dedup(spark):
    docs = fixtures.docs(spark)
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(["ab" * 90, "b" + "ab" * 60 + "c", "é" * 70, "xé" + "é" * 40, "q" * 50, "q" * 50, "q" * 49])], "doc_id long, text string")
    docs = docs.select("doc_id", "text", "digest").unionByName(more, allowMissingColumns=True)
    assert sorted(map(tuple, suffix_dedup(docs).drop("spans").collect())) == _removed(_plain(docs))
    assert suffix_dedup(fixtures.empty(spark)).collect() == []


def test_contexts_of_one_hash_are_kept_apart(tmp_path, monkeypatch):
    whole = suffix_dedup_module.contexts

    def coarse(data, ends, at):
        *rest, key = whole(data, ends, at)
        return *rest, key & np.uint64(1)

    monkeypatch.setattr(suffix_dedup_module, "contexts", coarse)
    draw = np.random.default_rng(5)
    letters = np.array(list("abcdefgh"))
    shared = ["".join(draw.choice(letters, n)) for n in (40, 52, 60, 90, 140)]
    docs = [(d, "".join(x for _ in range(4) for x in ("".join(draw.choice(letters, int(draw.integers(0, 20)))), shared[int(draw.integers(5))]))) for d in range(60)]
    shards = [docs[s::3] for s in range(3)]

    def land(name, frames):
        for i, (shard, payload) in enumerate(r for f in frames for r in f[["shard", "payload"]].itertuples(index=False)):
            folder = tmp_path / name / f"shard={shard}"
            folder.mkdir(parents=True, exist_ok=True)
            pq.write_table(pa.table({"payload": pa.array([payload], pa.binary())}), folder / f"{i}.parquet")

    def sent(stage):
        batches = [pa.RecordBatch.from_pydict({"shard": [s] * len(own), "doc_id": [d for d, _ in own], "text": [t for _, t in own]}) for s, own in enumerate(shards)]
        return list(stage(iter(batches)))

    copies, anchors, answers = ((tmp_path / n).as_uri() for n in ("copies", "anchors", "answers"))
    rows = pd.concat([b.to_pandas() for b in sent(suffix_dedup_module._send_anchors(4, copies))])
    land("anchors", [suffix_dedup_module._shared_anchors(g) for _, g in rows.groupby("bucket")])
    rows = pd.concat([b.to_pandas() for b in sent(suffix_dedup_module._send_contexts(4, anchors, copies))])
    replies = [suffix_dedup_module._answer_contexts(g) for _, g in rows.groupby("bucket")]
    assert {p[0] for f in replies for p in f["payload"]} == {0, 1}, "some contexts need their bytes, some don't"
    land("answers", replies)
    got = [tuple(r.values())[:5] for b in sent(suffix_dedup_module._mark(copies, answers)) for r in b.to_pylist()]
    assert sorted(got) == _removed(docs) and sum(r[2] for r in got) > 1000


def test_suffix_sort_orders_and_verifies():
    draw = np.random.default_rng(3)
    rows = draw.integers(97, 99, (300, 20)).astype(np.uint8)
    lengths = draw.integers(0, 21, 300)
    group = np.sort(draw.integers(0, 12, 300))
    order, lcp = suffix_sort(rows, lengths, group)
    strings = [rows[i, :lengths[i]].tobytes() for i in range(300)]
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], strings[i], i))
    for k in range(1, 300):
        a, b = order[k - 1], order[k]
        if group[a] == group[b]:
            n = next((i for i, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y), min(len(strings[a]), len(strings[b])))
            assert lcp[k] == n
        else:
            assert lcp[k] == -1


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def _components(rows, k, percent):
    sets = [(d, _shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d) if s else d) for d, s in sets)


def test_jaccard_components(spark):
    import random

    draw = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    near = []
    for i in range(70):
        words = base[: draw.choice([12, 30, 90])]
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
        near.append((1000 + i, " ".join(words)))
    docs = fixtures.docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for k, percent in ((3, 90), (5, 80)):
        assert sorted(map(tuple, jaccard_components(docs, k, percent).collect())) == _components(_plain(docs), k, percent)
    assert jaccard_components(fixtures.empty(spark)).collect() == []


@pytest.mark.parametrize("large", [8, 4096])
def test_jaccard_of_large_areas(spark, monkeypatch, large):
    """Areas above the limits, made of chains, of one passage with tails, and of one group with changes, lose no link."""
    import random

    from sievework.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "RARE", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    draw = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a chain: each shares most with the next only
        rows.append((i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 70))))
    for i in range(60):  # one passage, each with a tail of its own
        rows.append((100 + i, " ".join(base + [f"t{i}_{j}" for j in range(draw.randrange(9))])))
    for i in range(60):  # one group, changed in few places to few things
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(60)] = f"x{draw.randrange(5)}"
        rows.append((200 + i, " ".join(words[draw.randrange(3):])))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90) if large == 8 else (1, 80),):
        assert sorted(map(tuple, jaccard_join.jaccard_components(docs, k, percent).collect())) == _components(rows, k, percent)


def test_rows_of_one_passage_are_linear(spark):
    """Where one shingle links everything, what is searched grows with the documents, not with their square."""
    from pyspark.sql import functions as F

    from sievework.llm import jaccard_join

    def searched(n):
        found = []
        original = jaccard_join._units

        def counted(*a):
            out = original(*a)
            found.append(out.count())
            return out

        jaccard_join._units = counted
        try:
            text = F.concat(F.lit(" ".join(f"w{i}" for i in range(90))), F.lit(" tail"), F.col("id"), F.lit(" end"), F.col("id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit(" more"), F.col("id"), F.lit(" and"), F.col("id") % 50, F.lit(" x y z u v w"))).otherwise(""))
            got = jaccard_join.jaccard_components(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")), 3, 90)
            assert got.where("component_id = 0 or component_id = 1").count() >= n * 6 // 7
        finally:
            jaccard_join._units = original
        return sum(found)

    assert searched(4000) <= 2.5 * searched(2000) + 1000


def test_prefixes_of_links_meet():
    draw = np.random.default_rng(9)
    for percent in (80, 90):
        for _ in range(300):
            n = int(draw.integers(1, 60))
            x = np.unique(draw.integers(0, 10 ** 6, n).astype("<u8"))
            y = np.unique(np.concatenate((x[draw.random(len(x)) < 0.93], draw.integers(0, 10 ** 6, int(draw.integers(0, 4))).astype("<u8"))))
            both = np.intersect1d(x, y)
            rarity = {int(h): int(draw.integers(1, 9)) for h in both}
            one, two = (prefix_tokens(s, np.array([rarity.get(int(h), 0) for h in s]), percent) for s in (x, y))
            if len(y) and 100 * len(both) >= percent * len(np.union1d(x, y)):
                assert len(np.intersect1d(one, two))


def test_t_occurrence_skips_nothing():
    draw = np.random.default_rng(5)
    base = np.sort(draw.choice(10 ** 6, 60, replace=False)).astype("<u8")
    sets = [np.unique(np.concatenate((draw.choice(base, 56, replace=False), draw.integers(0, 10 ** 6, 3).astype("<u8")))) for _ in range(40)]
    links = {(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= required(len(sets[i]), len(sets[j]), 80)}
    found = t_occurrence(sets, np.arange(40), np.arange(40), 80)
    assert all((max(p), min(p)) in links for p in found)

    def count(edges):
        label = list(range(40))
        for a, b in edges:
            label = [label[b] if x == label[a] else x for x in label]
        return len(set(label))

    assert count(found) == count(links)
