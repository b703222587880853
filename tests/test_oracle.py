"""Every query with SQL gives what DuckDB gives, on the driver's smallest tables."""

import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.numeric import betting_lower_bound, hb_pvalues, indel_ratio
from sievework.functions.stemming import stem
from sievework.functions.text import SECTIONS, SEPARATORS, STOPWORDS, phrases
from sievework.operators import certify, dedup, learning
from sievework.plans import catalog, screening_queries, stopping_queries, text_queries
from sievework.session import landed

from .plain import plain_knees

DIR = os.environ.get("SIEVEWORK_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.8g}")
    return str(value) if isinstance(value, list) else value


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = oracle.execute(catalog.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted(df.select(*columns).collect()) == _sorted(got.fetchall())


#: Queries that SQL can't express; each is held against a plain version below.
PLAIN = {"certify", "certify_walk", "wsr_lcb_anchors", "calibrated_scores", "domain_keywords", "dedup_records", "dedup_without_titles", "phrase_extraction", "query_text", "section_split", "span_verify", "active_learning", "knee_learning", "target_learning", "estimate_learning", "estimate_learning_parts", "bucket_learning", "text_learning_logistic", "text_learning_svm", "text_learning_trees", "bm25_stemmed_topk"}


def test_every_query_is_checked():
    assert set(catalog.QUERIES) - set(catalog.SQL) == PLAIN


def _rows(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, DIR).collect()]


def _phrases(text):
    out, seen = [], set()
    for part in re.split(SEPARATORS.removeprefix("(?i)"), text or "", flags=re.I):
        tokens = re.sub(r"[()]", " ", part).split()
        while tokens and tokens[0].lower() in STOPWORDS:
            tokens = tokens[1:]
        phrase = " ".join(tokens)
        if any(len(w) >= 3 and w.lower() not in STOPWORDS for w in tokens) and phrase.lower() not in seen:
            seen.add(phrase.lower())
            out.append(phrase)
    return out


def test_phrases(spark, oracle):
    texts = dict(oracle.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in _rows(spark, "phrase_extraction"):
        want = _phrases(texts[r["doc_id"]])
        assert (r["n"], r["digest"]) == (len(want), hashlib.md5("|".join(want).encode()).hexdigest())
    got = spark.createDataFrame([("(aspirin, in adults) and the Placebo / PLACEBO or of x with (low dose) statins;the and",)], "t string").select(phrases(F.col("t")).alias("p")).first()["p"]
    assert got == ["aspirin", "adults", "Placebo", "low dose statins"]


def test_keywords_and_queries(spark, oracle):
    items = dict(oracle.execute("SELECT item_id, text FROM benchmark").fetchall())
    found, query = ({r["item_id"]: r for r in _rows(spark, n)} for n in ("domain_keywords", "query_text"))
    for i, text in items.items():
        parts = re.split(r"\.\s*", text)
        every = [p for k in range(4) for p in _phrases("; ".join(parts[k::4]))]
        assert found[i]["domain_keywords"] == list({p.lower(): p for p in reversed(every)}.values())[::-1] or [p.lower() for p in found[i]["domain_keywords"]] == list(dict.fromkeys(p.lower() for p in every))
        groups = [_phrases(", ".join(parts[k::2])) for k in (0, 1)]

        def term(p):
            content = [w for w in p.split() if len(w) >= 3 and w.lower() not in STOPWORDS]
            return f'"{p}"[TIAB]' if len(p.split()) <= 3 else "(" + " AND ".join(f"{w}[TIAB]" for w in content) + ")"

        want = " AND ".join("(" + " OR ".join(map(term, g)) + ")" for g in groups if g)
        assert query[i]["query"] == want + ' AND ("2010"[PDAT] : "2020"[PDAT])'


def test_sections(spark, oracle):
    texts = dict(oracle.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    heads = re.compile(r"(?i)^[ \t]*(?:\d+\.?[ \t]*)?(?:" + "|".join(n for ns in SECTIONS.values() for n in ns) + r")[ \t]*:?[ \t]*$", re.M)
    for r in _rows(spark, "section_split"):
        if heads.search(texts[r["doc_id"]]):
            continue
        methods, results = r["doc_id"] % 3 > 0 or r["doc_id"] % 2 > 0, r["doc_id"] % 2 > 0
        assert r["quality"] == (1.0 if methods and results else 0.5 if methods or results else 0.2)
        want = (["ABSTRACT"] if texts[r["doc_id"]].strip() else []) + (["METHODS"] if methods else []) + (["RESULTS"] if results else [])
        assert r["labels"] == ",".join(want)


def test_spans(spark, oracle):
    rows = oracle.execute("SELECT conv_id, turn, text FROM conversations").fetchall()
    got = {(r["conv_id"], r["turn"]): r["verified"] for r in _rows(spark, "span_verify")}
    kinds = {True: 0, False: 0}
    for c, t, text in rows:
        said = " ".join(re.split(r"\s+", text.strip(" "))[2:10])
        span = (said, said.upper(), re.sub("^(.{9}).", r"\1#", said), re.sub("[aeiou]", "#", said))[t % 4]
        n, low = len(span), text.lower()
        want = bool(span.strip()) and (span in text or span.lower() in low or any(indel_ratio(span.lower(), low[i:i + n]) >= 0.85 for i in {*range(0, max(1, len(low) - n + 1), max(1, n // 2)), max(0, len(low) - n)}))
        assert got[c, t] == want, (c, t)
        kinds[want] += 1
    assert min(kinds.values()) > 10


def test_record_dedup(spark, oracle):
    rows = [r.asDict() for r in dedup.keyed(text_queries._records(spark, DIR)).orderBy("seq").collect()]
    for name, titles in (("dedup_records", True), ("dedup_without_titles", False)):
        want, held = {}, ({}, {}, {})
        for r in rows:
            keys = (r["doi_key"], r["pmid_key"], r["title_key"] if titles else None)
            found = next((h[k] for h, k in zip(held[:2], keys) if k and k in h), None)
            if found is None and keys[2] is not None:
                found = held[2].get(keys[2])
                near = (v for k, v in held[2].items() if k == keys[2] or k and keys[2] and abs(len(k) - len(keys[2])) <= 0.05 * (len(k) + len(keys[2])) and indel_ratio(k, keys[2]) >= 0.95)
                found = next(near, None)
            want[r["seq"]] = r["seq"] if found is None else found
            if found is None:
                for h, k in zip(held, keys):
                    if k is not None and (k or h is held[2]):
                        h[k] = r["seq"]
        assert {r["seq"]: r["kept"] for r in _rows(spark, name)} == want


def test_certificates(spark, oracle):
    """Thresholds from a plain search over all grid points and rows, on DuckDB's scored corpus."""
    calib = oracle.execute(f"WITH {screening_queries.SCORED} SELECT topic_id, pmid, s, u, y, y_hat FROM calib").fetchall()
    tested = {}
    anchors = {(r["topic_id"], r["anchor"]): r["bound"] for r in _rows(spark, "wsr_lcb_anchors")}
    for topic in {r[0] for r in calib}:
        own = sorted((r for r in calib if r[0] == topic and r[4] == 1), key=lambda r: r[1])
        bounds = []
        for i, (lo, hi, tau) in enumerate(certify.ANCHORS):
            x = np.array([float(lo <= s < hi and u >= tau and v == 1) for _, _, s, u, _, v in own])
            bounds.append(betting_lower_bound(x, 0.03 / 12) if len(x) else 0.0)
            if len(x):
                assert anchors[topic, i] == pytest.approx(bounds[-1], abs=1e-9)
        tested[topic] = (len(own), min(bounds) if own else 0.0)
    grid = oracle.execute(f"WITH {screening_queries.GRID} SELECT topic_id, theta_idx, lambda_lo, lambda_hi, tau, m_plus, n_miss, cost FROM risks").fetchall()
    for name, order in (("certify", None), ("certify_walk", "safest")):
        got = {r["topic_id"]: r for r in _rows(spark, name)}
        for topic, (m, eta) in tested.items():
            assert got[topic]["m_plus"] == m and got[topic]["eta"] == pytest.approx(eta, abs=1e-9)
            if got[topic]["status"] != "certified":
                assert m < 26
                continue
            own = [(float(hb_pvalues(np.array([g[6]]), g[5], 0.1 + eta)[0]), *g) for g in grid if g[0] == topic]
            own.sort(key=(lambda g: (g[0], g[2])) if order is None else (lambda g: (g[3], g[4], -g[5], g[2])))
            good = []
            for i, g in enumerate(own):
                if g[0] > (0.07 / (len(own) - i) if order is None else 0.07):
                    break
                good.append(g)
            assert got[topic]["n_certified"] == len(good)
            assert got[topic]["theta_idx"] == (min(good, key=lambda g: (round(g[8], 12), g[2]))[2] if good else 0)


def test_calibrated_scores_are_monotone_and_better(spark, oracle):
    label = dict(oracle.execute("SELECT o_orderkey, (o_orderstatus = 'F')::INT FROM orders").fetchall())
    rows = sorted((r["s_raw"], r["s"], label[r["pmid"]]) for r in _rows(spark, "calibrated_scores"))
    assert all(0 <= s <= 1 for _, s, _ in rows)
    ups, downs = (all(d * b[1] >= d * a[1] - 1e-12 for a, b in zip(rows, rows[1:])) for d in (1, -1))
    assert ups or downs
    assert sum((s - y) ** 2 for _, s, y in rows) < sum((r - y) ** 2 for r, _, y in rows)


LICENSED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def licensed(spark):
    rows = stopping_queries._texts(spark, LICENSED)
    features = learning.tfidf(rows)
    return landed(features(rows), "licensed"), landed(features(spark.createDataFrame([(stopping_queries.TOPIC,)], "text string")), "licensed-topic")


@pytest.mark.parametrize("kind", ["logistic", "linear_svm", "boosted_trees"])
def test_rankers_start_from_the_topics_text(licensed, kind):
    docs, topic = licensed
    n, total = docs.agg(F.count("*"), F.sum("rel")).first()
    model = learning.fitted(docs.limit(0), docs.orderBy(F.xxhash64("pmid")).limit(100), topic, getattr(learning, kind)())
    first = learning._best(learning._scored(docs, model, 1), 60).agg(F.sum("rel")).first()[0]
    assert first >= 3 * total * 60 / n  # at random, total * 60 / n


def test_text_learning_reaches_its_recall(licensed):
    docs, topic = licensed
    n, total = docs.agg(F.count("*"), F.sum("rel")).first()
    log = _log([r.asDict() for r in learning.autotar(docs, 0.9, batch=20, growth=1.0, topic=topic).collect()])
    assert log[-1]["found"] >= 0.9 * total and all(r["found"] < 0.9 * total for r in log[:-1])
    assert log[-1]["assessed"] <= 0.35 * n


def test_tfidf_equals_a_plain_count(spark):
    texts = ["Alpha beta beta gamma", "the beta of gamma delta", "alpha x 12 12", None, "The"]
    rows = spark.createDataFrame(list(enumerate(texts)), "pmid long, text string")
    got = {r["pmid"]: sorted(r["features"].values) for r in learning.tfidf(rows)(rows).collect()}
    words = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in ("the", "of")] for t in texts]
    df = {w: sum(w in ws for ws in words) for ws in words for w in ws}
    for i, ws in enumerate(words):
        raw = [ws.count(w) * (math.log((1 + 5) / (1 + df[w])) + 1) for w in set(ws) if df[w] >= 2]
        norm = math.sqrt(sum(x * x for x in raw)) or 1
        assert got[i] == pytest.approx(sorted(x / norm for x in raw))


def test_stemmed_ranking(spark, oracle):
    from pyspark.ml.feature import StopWordsRemover

    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    bags = {d: [stem(w) for w in re.sub("[!-/:-@\\[-`{-~]+", " ", (t or "").lower()).split() if w not in stop] for d, t in oracle.execute("SELECT doc_id, text FROM documents").fetchall()}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(s for b in bags.values() for s in set(b))
    idf = {s: math.log(n - k + 0.5) - math.log(k + 0.5) for s, k in df.items()}
    mean, scores = sum(idf.values()) / len(idf), {}
    for d, b in bags.items():
        held = Counter(b)
        parts = [(idf[q] if idf[q] >= 0 else 0.25 * mean) * held[q] * 2.5 / (held[q] + 1.5 * (0.25 + 0.75 * len(b) / avg)) for q in ("work", "licens", "licens", "author", "worthless", "version", "hatr") if held[q]]
        if parts:
            scores[d] = round(sum(parts), 6)
    want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = sorted(_rows(spark, "bm25_stemmed_topk"), key=lambda r: r["rank"])
    assert got and [(r["doc_id"], r["score"]) for r in got] == [(d, pytest.approx(s, abs=2e-6)) for d, s in want]


def test_active_learning_reaches_its_recall(spark, oracle):
    total = oracle.execute("SELECT count(*) FROM embeddings WHERE label = 1").fetchone()[0]
    rows = sorted(_rows(spark, "active_learning"), key=lambda r: r["round"])
    assert rows[-1]["found"] >= 0.9 * total and all(r["found"] < 0.9 * total for r in rows[:-1])
    assert all(b["assessed"] > a["assessed"] and b["found"] >= a["found"] for a, b in zip(rows, rows[1:]))


def _log(rows):
    rows = sorted(rows, key=lambda r: r["round"])
    assert [r["round"] for r in rows] == list(range(len(rows)))
    assert all(b["assessed"] >= a["assessed"] and b["found"] >= a["found"] for a, b in zip(rows, rows[1:]))
    return rows


def test_learning_stops_where_its_rule_says(spark, oracle):
    n, total = oracle.execute("SELECT count(*), count(*) FILTER (label = 1) FROM embeddings").fetchone()
    log = _log(_rows(spark, "knee_learning"))
    curve = [(r["assessed"], r["found"]) for r in log]
    rule = []
    for i, (n2, r2) in enumerate(curve):
        at = plain_knees(curve[: i + 1])
        n1, r1 = curve[at[-1]] if at else (0, 0)
        rule.append(n2 > 100 and bool(at) and (r1 / n1) / ((r2 - r1 + 1) / (n2 - n1)) > 2.0)
    assert not any(rule[:-1]) and (rule[-1] or log[-1]["assessed"] == n)
    log = _log(_rows(spark, "target_learning"))
    assert log[-1]["found"] >= min(10, total)
    for rows, recall in [(_rows(spark, "estimate_learning"), 0.9)] + [([r for r in _rows(spark, "estimate_learning_parts") if r["part"] == p], 0.8) for p in (0, 1)]:
        log = _log(rows)
        stops = [r["found"] > 0 and r["round"] > 0 and r["found"] >= recall * r["estimate"] for r in log]
        assert not any(stops[:-1]) and (stops[-1] or log[-1]["found"] >= recall * total / 2)
        assert all(r["estimate"] >= r["found"] - 1e-9 for r in log)
    log = _log(_rows(spark, "bucket_learning"))
    assert all(b["estimate"] >= a["estimate"] for a, b in zip(log, log[1:])) and log[0]["kept"] and log[-1]["assessed"] < 0.8 * n + 60
    assert 0.4 * total <= log[-1]["estimate"] <= 1.3 * total
