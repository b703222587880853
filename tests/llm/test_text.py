import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import decontamination, pii, quality, token_output, toxicity

from . import fixtures
from .test_dedup import _plain, _shingles

public = pytest.importorskip("public_tokenizers")
TOKENIZER = public.path("word_bpe_49k.json")


def test_packing_round_trip():
    draw = np.random.default_rng(1)
    for vocabulary in (2, 3, 300, 5000, 49_408, 65_536, 70_000, 1 << 20):
        bits = token_output.width(vocabulary)
        ids = draw.integers(0, vocabulary, 1001).astype("<u4")
        assert (token_output.unpack(token_output.pack(ids, bits), bits, 1001) == ids).all()
        assert 1 << bits >= vocabulary > (1 << bits) // 2


def test_reader_has_random_access(tmp_path):
    draw = np.random.default_rng(2)
    docs = [(i, draw.integers(0, 5000, n).astype("<u4")) for i, n in enumerate([0, 3, 1000, 1, 77, 0, 513])]
    with open(tmp_path / "x", "wb") as out:
        writer = token_output.TokenWriter(out, 13, block_ids=64)
        for d, ids in docs:
            writer.add(d, ids)
        writer.close()
    with open(tmp_path / "x", "rb") as source:
        reader = token_output.TokenReader(source, (tmp_path / "x").stat().st_size)
        whole = np.concatenate([i for _, i in docs])
        assert [(d, i.tolist()) for d, i in reader.documents(per_read=100)] == [(d, i.tolist()) for d, i in docs]
        for a, b in ((0, 1), (63, 65), (500, 1200), (len(whole) - 1, len(whole))):
            assert (reader.ids(a, b) == whole[a:b]).all()


def test_token_output(spark):
    from tokenizers import Tokenizer

    docs = fixtures.docs(spark)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    start, want = 0, []
    for d, t in sorted(_plain(docs), key=lambda r: (r[0], r[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_output(docs, TOKENIZER).collect())) == want
    assert token_output.token_output(fixtures.empty(spark), TOKENIZER).collect() == []


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    enc, plain = token_output.PieceEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    draw = random.Random(11)
    long_ = "".join(draw.choice(["word", "Été", "x1", "<|endoftext|>", "it's", "!?", "\u00a0"]) + draw.choice(" \n ") * draw.randrange(3) for _ in range(300_000))
    texts = [long_, "x<|endoftext|>y", "a<|startoftext|>. b.<|endoftext|>!", "<|endoftext|", "it's don'T I'LL'd a's'", "x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ ﬁne", "été x́", "a1b2 3.14 ½ Ⅷ x²", "..,!! word!!.. \"quo\"###", "a\u0085c d", "\U0001F600ok 日本語 مرحبا", "a\x00b", "", "   "]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(long_) > 1 << 20 and 49407 in np.frombuffer(want[1], "<u4")
    assert enc.by_pieces and enc.encode_many(texts) == want == enc.encode_many(texts)
    other = token_output.PieceEncoder(public.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not other.by_pieces and other.encode_many(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, body):
    digits = re.sub("[^0-9]", "", body)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in body.split(".") if kind == "ip"), "phone": 10 <= len(digits) <= 15}[kind]


def test_pii_base_spans(spark):
    more = ["a.b@c.d_e@f.gh x@y z@@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 1.02.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112 1", "+1 (509) 555-6973+ +12 ) ( 3 +1-2", "é ü\U0001F600 a@b.cd +1 (509) 555-6973", "9" * 20000, "1 " * 9000, 'mail (at) host (dot) com token = "2b0cb261201f091f991b2c1144aa"', "+1234567890123456 +1.2.3.4.5.6.7.8.9.10"]
    docs = fixtures.docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    for d, t in _plain(docs):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if _valid(kind, m.group()))
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in spans) for k in PATTERNS]
        assert set(text.split(",")) - {""} <= set(got[d]["spans"].split(","))
    assert "written_email" in got[507]["spans"] and "secret" in got[507]["spans"]
    assert pii.pii_digest(fixtures.empty(spark)).collect() == []
    plan = pii.find_pii(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_added_spans(spark):
    """Planted credentials, names, written-out addresses and local numbers are found, look-alikes left alone."""
    draw = random.Random(12)
    digits = "0123456789"

    def some(letters, n):
        return "".join(draw.choice(letters) for _ in range(n))

    good = {
        "secret": [lambda: f"password={some('abcdef0123456789', 20)}a1", lambda: f'token = "{some("abcdef0123456789", 40)}"', lambda: f"AKIA{some('ABCDEFGHIJKLMNOP0123456789', 12)}7Q2X"],
        "written_email": [lambda: f"write to {some('abc', 5)} (at) {some('xyz', 5)} (dot) com"],
        "local_phone": [lambda: f"tel ({some('23456789', 3)}) {some('23456789', 3)}-{some(digits, 4)}"],
        "name": [lambda: f"contact Dr {draw.choice(['Anna', 'Peter', 'Claire', 'Carlos'])} {draw.choice(['Stone', 'Miller'])}"],
    }
    bad = [lambda: f"commit {some('0123456789', 12)}-{some('0123456789', 12)}", lambda: f"version {some(digits, 3)}.{some(digits, 3)}.{some(digits, 3)}", lambda: f"a_{some('abc', 8)}_{some('abc', 8)}_{some('def', 8)}", lambda: "it was done (at) home."]
    rows, want = [], {}
    for i in range(400):
        words = [some("abcdefgh", draw.randrange(2, 9)) for _ in range(30)]
        if i % 2:
            kind = draw.choice(list(good))
            words[15] = draw.choice(good[kind])()
            want[i] = kind
        else:
            words[15] = draw.choice(bad)()
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: {x.split(":")[0] for x in r["spans"].split(",") if x} for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [want[i] in got[i] for i in want]
    spoilt = [bool(got[i]) for i in range(0, 400, 2)]
    missed = sorted({want[i] for i in want if want[i] not in got[i]})
    assert not missed or sum(caught) >= 0.9 * len(caught), missed
    assert sum(caught) >= 0.9 * len(caught) and sum(spoilt) <= 0.05 * len(spoilt), (sum(caught) / len(caught), sum(spoilt) / len(spoilt))


def test_pii_classifier_sees_more_than_votes(spark):
    # patterns: kind, five votes, shape, and the features of the context
    sure, unsure, split = "4,1,1,1,0,1,0", "4,0,0,0,-1,-1,0", "4,1,0,0,-1,0,0"
    counts = {f"{sure},1,0,1": 90, f"{sure},0,0,0": 10, f"{unsure},1,0,1": 10, f"{unsure},0,0,0": 90, f"{split},1,0,1": 5, f"{split},0,0,0": 5}
    found = spark.createDataFrame([([(p,)] * n,) for p, n in counts.items()], "candidates array<struct<pattern:string>>")
    verdict = pii.span_classifier(found).first()["verdict"]
    assert set(verdict) == set(counts) and verdict[f"{sure},1,0,1"] > 0.8 and verdict[f"{unsure},0,0,0"] < 0.2
    assert verdict[f"{split},1,0,1"] > verdict[f"{split},0,0,0"] + 0.1, "equal votes, unlike contexts"
    texts = ["Dr. Ann Poe", "see (Dr. Ann Poe)", "so says Dr. Ann Poe of", "x" * 40 + " Dr. Ann Poe", "y" * 40 + "\n Dr. Ann Poe,"]
    rows = pii._found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["candidates"][0]["pattern"].split(",")[-3:] for r in rows] == [["0", "1", "1"], ["1", "0", "1"], ["0", "0", "0"], ["0", "0", "1"], ["0", "1", "1"]]


def test_pii_of_very_long_texts(spark):
    """A megabyte of what a pattern could start with costs a pass, not a pass for each character."""
    size = 1 << 20
    made = ["a" * size + " @", "a." * (size // 2) + "@", "a@b" + ".c" * (size // 2), "x@y.z_" * (size // 6), "1 " * (size // 2), "1." * (size // 2), "9" * size + "@", "+1 (" * (size // 4), "(at)" + "a" * size, "4111111111111111," * (size // 17), "é 1.2.3.4 " * (size // 11)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    for d, t in enumerate(made):
        # Python's own search is quadratic where a run has no match
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) if (kind != "email" or d in (2, 3)) and (kind, d) != ("ip", 6) for m in re.finditer(p, t) if _valid(kind, m.group()))
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans).encode()).hexdigest(), d


def test_leaks(spark):
    draw = random.Random(6)
    items = [(i, " ".join(f"q{draw.randrange(400)}" for _ in range(n))) for i, n in enumerate([5, 8, 20, 60, 300])] + [(5, None), (6, "too short"), (7, " ".join(f"z{i}" for i in range(30))), (7, "same id other text of five words"), (None, "a b c d e f")]
    texts = []
    for i, (_, t) in enumerate(items):
        words = (t or "").split()
        noise = [f"n{draw.randrange(10 ** 6)}" for _ in range(3000)]
        texts += [(100 + 3 * i, " ".join(noise[:1500] + words + noise[1500:]).upper()), (101 + 3 * i, " ".join(noise[:50] + words[: len(words) // 2] + noise[50:])), (102 + 3 * i, " ".join(words[: len(words) // 2] + ["gap"] + words[len(words) // 2:]))]
    docs = fixtures.docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in _plain(docs):
        for i, q in items:
            own = {s for s in _shingles(q, 5) if len(s) == 5}
            if i is not None and own and 100 * len(own & _shingles(t, 5)) >= 80 * len(own):
                want.append((d, i, len(own & _shingles(t, 5)), len(own)))
    got = decontamination.leaks(docs, table).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and len(want) >= 8
    assert decontamination.leaks(fixtures.empty(spark), table).collect() == []
    assert decontamination.leaks(docs, table.limit(0)).collect() == []


def test_short_leaks_are_all_found():
    draw = np.random.default_rng(10)
    for size in (1, 2, 3, 5, 9, 16, 17):
        items = draw.integers(0, 1 << 64, (1000, size), np.uint64)
        index = decontamination.ItemIndex([(i, np.unique(x).astype("<u8").tobytes()) for i, x in enumerate(items)])
        noise = draw.integers(0, 1 << 64, (1000, 40), np.uint64)
        h = np.concatenate([np.concatenate((n[: 20 + i % 16], x, n[20 + i % 16:])) for i, (n, x) in enumerate(zip(noise, items, strict=True))])
        for number, want in ((np.zeros(len(h), np.int64), np.zeros(1000, np.int64)), (np.repeat(np.arange(1000), 40 + size), np.arange(1000))):
            assert index.verified(number, h, 80) == [(t, i, size) for t, i in zip(want.tolist(), range(1000), strict=True)]


def _judged(n=400):
    draw = random.Random(8)
    out = []
    for i in range(n):
        words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9))) for _ in range(60)]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if junk:
            words = [w.upper() + "!!" if i % 2 else w + "$$$" for w in words]
        if toxic:
            for _ in range(4):
                words[draw.randrange(60)] = draw.choice(["zornwurm", "klotzkopf", "mistfink", "z-o-r-n-w-u-r-m"])
        out.append((i, " ".join(words), "en", "a", 1, int(not junk), int(toxic)))
    return out


def test_quality(spark):
    rows = _judged()
    docs = fixtures.docs(spark).select("doc_id", "text", "lang", "source", "n_chars", "digest").withColumn("doc_id", fixtures_offset()).unionByName(spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:300]] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    unseen = [(got[r[0]], bool(r[5])) for r in rows[300:]]
    assert sum(a == b for a, b in unseen) >= 98 and all(a for a, b in unseen if b)
    assert len(got) == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(fixtures.empty(spark), labels).collect() == []


def test_tiny_shares_draw_some(spark):
    """A share is cut from 64 bits of hash: a billionth of very many rows is some rows, not none."""
    from sievework.llm.common import drawn

    at = spark.range(1_000_000)
    for share in (0.5, 1e-2, 1e-4):
        for last in (False, True):
            assert abs(at.where(drawn("id", share, last)).count() - 1e6 * share) <= 6 * (1e6 * share) ** 0.5
    low = at.selectExpr("min(xxhash64(id))").first()[0]
    assert at.where(drawn("id", (low + 2 ** 63 + 2 ** 12) / 2 ** 64)).count() == 1
    assert at.where(drawn("id", 1.0)).count() == 1_000_000


def test_quality_features_do_not_depend_on_length():
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9))) for _ in range(3000)]
    raw = b"".join(f"{draw.choice(words)}{chr(10) if draw.random() < 0.1 else ' '}".encode() for _ in range(quality.PIECE // 5))
    under, over = raw[: quality.PIECE - 500], raw[: quality.PIECE + 500]
    assert len(under) < quality.PIECE < len(over) < len(raw)
    got = quality.text_features([under, over, b""])
    assert np.abs(got[0] - got[1]).max() < 0.01
    own = over.split()
    assert np.allclose(got[1, -5:-3], (np.log1p(len(over) / len(own)) / 3, len(set(own)) / len(own)))


def fixtures_offset():
    from pyspark.sql import functions as F

    return F.col("doc_id") + 10_000


def test_subsequence_kernel_equals_plain_enumeration():
    draw = random.Random(8)
    units = [bytes([27, *(draw.randrange(1, 6) for _ in range(draw.randrange(0, 14))), 28]) for _ in range(40)] + [bytes([27, 28]), bytes([27, 3, 28])]

    def plain(unit):
        weights = Counter()
        for at in itertools.combinations(range(len(unit)), 3):
            skipped = at[2] - at[0] - 2
            if at[2] - at[0] < toxicity.SPAN:  # all three within SPAN symbols
                weights[tuple(unit[i] for i in at)] += toxicity.DECAY**skipped
        return {s: w / max(1, len(unit) - 2) ** 0.5 for s, w in weights.items()}

    want = [plain(u) for u in units]
    codes = toxicity._symbols(units)
    full = toxicity.subsequences(codes)
    for got, w in zip(full, want, strict=True):
        at = np.flatnonzero(got)
        assert {(i // 1024, i // 32 % 32, i % 32) for i in at.tolist()} == set(w)
        np.testing.assert_allclose([got[(a * 32 + b) * 32 + c] for a, b, c in w], list(w.values()), rtol=1e-5)
    for i in (0, 7, len(units) - 2):  # a unit's decision by another's table is their kernel value
        kernel = [sum(w * x.get(s, 0) for s, w in want[i].items()) for x in want]
        np.testing.assert_allclose(toxicity.decisions(codes, full[i]), kernel, rtol=1e-4, atol=1e-6)
    row = np.arange(len(units)) % 5
    np.testing.assert_allclose(toxicity.subsequences(codes, row, 5), np.stack([full[row == r].sum(axis=0) for r in range(5)]), rtol=1e-4, atol=1e-6)


def test_views_teach_each_other():
    draw = np.random.default_rng(11)

    def sample(n):
        y = draw.integers(0, 2, n)
        return y, [np.where(draw.random((n, 40)) < np.where(y[:, None] == side, 0.72, 0.5), 1.0, 0.0) for side in (1, 0)]

    y, views = sample(4000)
    few = np.arange(4000) < 60
    label, apart = np.where(few, y, -1), (np.arange(4000) % 3 == 0) & few
    alone, taught = (quality.co_train(views, label, apart, rounds) for rounds in (0, quality.ROUNDS))
    fresh, seen = sample(4000)

    def right(model):
        return [((score > 0.5) == fresh).mean() for score in quality.apply_model(model, seen)]

    before, after = right(alone), right(taught)
    assert after[0] > before[0] + 0.02 and after[1] > before[1] + 0.02, (before, after)
    assert after[2] > max(before) + 0.02 and after[2] > max(after[:2]), (before, after)


def test_toxicity(spark):
    rows = _judged()
    docs = fixtures.docs(spark).select("doc_id", "text", "digest").withColumn("doc_id", fixtures_offset()).unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    test = [(got[r[0]]["predicted"], r[6]) for r in rows if got[r[0]]["held_out"]]
    assert {d for d in got if got[d]["held_out"]} == {d for d in got if zlib.crc32(str(d).encode()) % 3 == 1}
    assert 100 < len(test) and sum(a == b for a, b in test) >= 0.97 * len(test)
    draw = random.Random(13)
    forms = ["zornXwurm", "kl-otz-kopf", "m i s t f i n k", "mist.fi.nk", "zor*nwurm", "klotzqkopf", "m1stf1nk"]
    fresh = [(5000 + i, " ".join(["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9))) for _ in range(40)] + ([draw.choice(forms) for _ in range(3)] if i % 2 else []))) for i in range(200)]
    model = toxicity.train(docs, labels)
    unseen = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum(unseen[d] for d, _ in fresh if d % 2) >= 80 and sum(unseen[d] for d, _ in fresh if d % 2 == 0) <= 5
    flipped = spark.createDataFrame([(r[0], 1 - r[6] if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[6]) for r in rows], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, flipped).collect()}
    assert all(again[d] == got[d]["score"] for d in got), "held-out labels must not matter"
    assert len({r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()}) == 1
    assert toxicity.classify(fixtures.empty(spark), labels).collect() == []
