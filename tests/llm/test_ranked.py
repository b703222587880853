"""Lexical search, language identification and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import language, lexical_search, resampling
from sievework.llm.shingles import PIECE

from . import fixtures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _plain(df, id_col="doc_id"):
    return [(r[0], r[1] or "") for r in df.select(id_col, "text").where(f"{id_col} is not null").collect()]


def _terms(text):
    return TERM.findall(text.translate(_LOWER))


def _search(docs, items, k):
    docs = [(d, _terms(t)) for d, t in docs]
    N, L = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += _terms(t)
    out = []
    for i, terms in asked.items():
        found = []
        for d, own in docs:
            tf = Counter(own)
            m = 25 + (75 * len(own) * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                found.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


ITEMS = [(1, "alpha delta7 Été straße"), (2, "lorem lorem ipsum x1 BETA"), (3, None), (4, "!!"), (5, "nowhere else"), (1, "dolor delta7 end"), (None, "alpha"), (6, "one two"), (7, "tail words here gamma3 sit4 dolor")]


def _items(spark):
    return spark.createDataFrame([(i, t, "d", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int")


@pytest.mark.parametrize("shard_bytes", [400, 1 << 20])
def test_search(spark, shard_bytes):
    docs, items = fixtures.docs(spark), _items(spark)
    index = lexical_search.build_index(docs, shard_bytes=shard_bytes)
    got = lexical_search.search(index, items, 5)
    assert [f.name for f in got.schema] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == _search(_plain(docs), _plain(items, "item_id"), 5)


def test_search_in_blocks_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", 3)
    docs, items = fixtures.docs(spark), _items(spark)
    assert sorted(map(tuple, lexical_search.search(lexical_search.build_index(docs), items, 4, block=2, span=7).collect())) == _search(_plain(docs), _plain(items, "item_id"), 4)


def test_search_of_nothing(spark):
    docs, items = fixtures.docs(spark), _items(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.ranked_search(fixtures.empty(spark), items).collect() == []
    assert lexical_search.ranked_search(docs, none).collect() == []
    assert lexical_search.ranked_search(docs.withColumn("text", docs["text"].substr(1, 0)), items).collect() == []


def test_search_reads_long_texts_whole(spark):
    long_ = "filler, " * (PIECE // 6) + "needle9 " + "wörd" * (PIECE // 4) + " last7"
    docs = spark.createDataFrame([(1, long_), (2, "needle9"), (3, "filler last7 other")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "needle9 last7"), (1, "filler"), (2, "wörd" * (PIECE // 4))], "item_id long, text string")
    assert sorted(map(tuple, lexical_search.ranked_search(docs, items).collect())) == _search(_plain(docs), _plain(items, "item_id"), 10)


def test_max_score_equals_full_scores_and_skips():
    draw = np.random.default_rng(5)
    for trial in range(60):
        n, lists, full = 3000, [], np.zeros(3000, np.int64)
        for size in (3, 40, 600, 1500, 2900):
            numbers = np.sort(draw.choice(n, size, replace=False))
            own = lexical_search.List(numbers, draw.integers(0, 50, size), np.arange(0, n + lexical_search.RANGE, lexical_search.RANGE))
            factor = int(draw.integers(0, 4000 // size + 2))
            lists.append((own, factor))
            np.add.at(full, numbers, factor * own.impacts)
        want = [(i, full[i]) for i in np.lexsort((np.arange(n), -full))[:10] if full[i] > 0]
        assert list(zip(*(x.tolist() for x in lexical_search.max_score(lists, n, 10)), strict=True)) == want
    # once ten documents of the rare list are known, the long list alone can't qualify: its other documents are never scored
    edges = np.arange(0, 4096 + 512, 512)
    rare, common = lexical_search.List(np.arange(0, 4096, 30), np.full(137, 1000), edges), lexical_search.List(np.arange(4096), np.full(4096, 1), edges)
    reads = []

    class Watched:
        def __getitem__(self, at):
            found = np.ones(4096, np.int64)[at]
            reads.append(found.size)
            return found

    common.impacts = Watched()
    lexical_search.max_score([(rare, 1), (common, 1)], 4096, 10)
    assert sum(reads) < 1500


# language identification


def _profile(text, most):
    words = re.findall(r"[^\W\d_]+", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text))
    grams = Counter(w2[i:i + n] for w in words for w2 in [f" {w} "] for n in (1, 2, 3) for i in range(len(w2) - n + 1))
    # bigrams and trigrams within a word and its blanks, letters alone; a blank between two words counts once
    grams.pop(" ", None)
    top = sorted(grams.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + list(map(ord, x[0]))))[:most]
    ranks, i = {}, 0
    while i < len(top):
        j = i
        while j < len(top) and top[j][1] == top[i][1]:
            j += 1
        ranks |= {g: i + (j - i - 1) / 2 for g, _ in top[i:j]}
        i = j
    return grams, ranks


def _key(gram):
    return sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))


def test_ngrams_and_ranks_equal_a_plain_count():
    for text in ("The cat's 3 hats, the  End", "Été à Łódź", "a", "x1y", "ΑΒΓ straße İx", "日本 語", "𐐀𐐁 ok"):
        grams, ranks = _profile(text, 50)
        keys, counts = language.ngrams(language.letters(text))
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {_key(g): n for g, n in grams.items()}
        own = language.profile(keys, counts, 50)
        assert dict(zip(own[0].tolist(), own[1].tolist(), strict=True)) == {_key(g): r for g, r in ranks.items()}


def test_ngrams_of_long_texts(monkeypatch):
    text = "Abc déf-ghi j " * 50
    whole = language.ngrams(language.letters(text))
    for piece in (3, 5, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, language.ngrams(language.letters(text)), strict=True))


def test_language_equals_brute_force(spark):
    draw = random.Random(4)
    words = {"aa": ["katze", "hund", "über", "maus", "und"], "bb": ["chat", "été", "chien", "et", "souris"], "cc": ["gatto", "cane", "e", "topo", "là"]}
    rows = []
    for i in range(240):
        lang = draw.choice(list(words))
        rows.append((i, " ".join(draw.choice(words[lang]) for _ in range(draw.randrange(1, 30))), lang if draw.random() < 0.8 else None))
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 !?", "cc"), (503, "katze hund", None), (503, "chat chien", None), (None, "katze", "aa"), (504, "一", None), (505, "über " * 300_000, "aa")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = language.language_id(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    learned = defaultdict(Counter)
    for d, t, lang in rows:
        if d is not None and lang and t and zlib.crc32(str(d).encode()) % 4 != 2:
            grams, _ = _profile(t, 400)
            for g, n in grams.items():
                learned[lang][g] += n * language.UNIT // max(sum(grams.values()), language.LONG)
    profiles = {}
    for lang, grams in learned.items():
        top = sorted(grams.items(), key=lambda x: (-x[1], _key(x[0])))[:400]
        profiles[lang] = {g: sum(i for i, x in enumerate(top) if x[1] == n) / sum(1 for x in top if x[1] == n) for g, n in top}
    want = []
    for d, t, _ in rows:
        if d is None:
            continue
        _, ranks = _profile(t or "", 400)
        held = zlib.crc32(str(d).encode()) % 4 == 2
        if not ranks:
            want.append((d, held, "und", 0.0))
            continue
        dist = sorted((sum(abs(r - p[g]) if g in p else 400 for g, r in ranks.items()), lang) for lang, p in profiles.items())
        want.append((d, held, dist[0][1], round((dist[1][0] - dist[0][0]) / dist[1][0], 9)))
    assert sorted((*r[:3], round(r[3], 9)) for r in map(tuple, got.collect())) == sorted(want)


def test_language_of_nothing(spark):
    docs = fixtures.docs(spark)
    none = docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang is not null and false").unionByName(docs.selectExpr("doc_id", "text", "null as lang", "source", "n_chars", "digest", "keep_id", "n", "copies", "size"))
    assert {(r["lang_pred"], r["score"]) for r in language.language_id(none).collect()} == {("und", 0.0)}
    assert language.language_id(fixtures.empty(spark)).collect() == []


def test_language_sample_is_bounded_for_each_language(spark):
    docs = spark.createDataFrame([(i, "wort", "de" if i % 50 else "fr") for i in range(4000)], "doc_id long, text string, lang string")
    model = language.train(docs, sample=100)
    assert model.languages == ["de", "fr"]  # the rare language is learned from all its documents
    assert language.train(docs, languages=1).languages == ["de"]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = language.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    n, right = got.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert n > 100 and right >= 0.98 * n


# importance resampling


def _resample(docs, target, percent, least):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [(d, *feats(t)) for d, t in docs]
    s, t = Counter(x for _, _, f in docs for x in f), Counter(x for _, text in target for x in feats(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, words, f in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def _same(got, want):
    # of equal rows it isn't said which one is drawn; none of the rows differ otherwise
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize(("percent", "range_rows"), [(5, 1 << 18), (40, 5), (100, 7), (0, 3)])
def test_resample(spark, percent, range_rows):
    docs, target = fixtures.docs(spark, n=300), _items(spark)
    got = resampling.resample(docs, target, percent, range_rows=range_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    _same(got, _resample(_plain(docs), _plain(target, "item_id"), percent, 20))


def test_resample_of_nothing(spark):
    docs, none = fixtures.docs(spark), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(fixtures.empty(spark), _items(spark)).collect() == []
    _same(resampling.resample(docs, none, 30), _resample(_plain(docs), [], 30, 20))


def test_features_of_many_and_long_texts(monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "B", "zz", "é", "9", " ", "  ", "-", "'", "x" * draw.randrange(300)]) for _ in range(draw.randrange(60))) for _ in range(200)]
    texts += ["long wörds, " * (PIECE // 8), "x" * (PIECE + 5) + " y z", "", " ", "w" * 64 + " " + "w" * 65 + " " + "w" * 128]
    got = [[0, Counter()] for _ in texts]
    for group, words, runs in resampling.features([t.encode() for t in texts]):
        for i, n in zip(group, words, strict=True):
            got[i][0] += n
        for text, bucket in runs:
            assert (np.diff(text) >= 0).all()
            for i, b in zip(group[text].tolist(), bucket.tolist(), strict=True):
                got[i][1][b] += 1
    for t, (n, buckets) in zip(texts, got, strict=True):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        assert n == len(w)
        assert buckets == Counter(zlib.crc32(b" ".join(w[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_tournament_tree_merges_runs_added_on_the_way():
    draw = random.Random(8)
    for _ in range(50):
        rows = [(draw.randrange(40), draw.randrange(100)) for _ in range(draw.randrange(200))]
        runs = sorted((sorted(rows[i::7], key=resampling.TournamentTree.key) for i in range(7) if rows[i::7]), key=lambda r: resampling.TournamentTree.key(r[0]))
        tree, out = resampling.TournamentTree(), []
        while runs or tree.first() is not None:
            while runs and (tree.first() is None or tree.key(runs[0][0]) < tree.key(tree.first())):
                tree.add(iter(runs.pop(0)))
            out.append(tree.take())
        assert out == sorted(rows, key=resampling.TournamentTree.key)


def test_draw_of_one_score(spark):
    rows = spark.createDataFrame([(7, 1, 5, 5, 30)] * 50 + [(i, 1, 5, 5, 30) for i in range(100, 150)] + [(1, 1, 9, 9, 3)], "doc_id long, n_features long, weight long, score long, n_words long").repartition(4)
    got = resampling.draw(rows, 60, "n_words >= 20", range_rows=8, run_rows=9).collect()
    assert len(got) == 101 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [7] * 50 + list(range(100, 110))
