import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.functions.numeric import indel_ratio
from sievework.operators import baselines, dedup, evaluator, learning, ranking, review, routing, splits, votes
from sievework.plans import screening_run
from sievework.sources import judgments, stores
from sievework.streaming import events


def _one(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_keys_and_tokens(spark):
    r = _one(spark, " HTTPS://dx.doi.org/10.1/AB ").select(tx.doi_key(F.col("x")), tx.title_key(F.lit("  A\t B ")), tx.slug(F.lit("--A b/C--")), tx.approx_tokens(F.lit("one two three")), tx.strip_markup(F.lit("<b>a</b>\n b"))).first()
    assert tuple(r) == ("10.1/ab", "a b", "a_b_c", 4, "a b")
    assert _one(spark, "").select(tx.doi_key(F.col("x")), tx.pmid_key(F.lit(" "))).first() == (None, None)


def test_phrases(spark):
    r = _one(spark, "the adults with type 2 diabetes (T2D) and Obesity, obesity; of it").select(tx.phrases(F.col("x"))).first()[0]
    assert r == ["adults", "type 2 diabetes T2D", "Obesity"]


def test_phrases_after_a_long_run_of_stopwords(spark):
    got = _one(spark, "the of " * 20_000 + "aspirin, a " + "an " * 50_000, "THE " * 30_000).select(tx.phrases(F.col("x"))).collect()
    assert [r[0] for r in got] == [["aspirin"], []]


def test_title_segments_are_not_sent_through_the_driver(spark):
    titles = spark.createDataFrame([("effects of aspirin on adults with fever",), ("effects of aspirin on adults with fevers",), ("another",)], "title_key string")
    pairs = dedup.near_titles(dedup.title_probes(titles, longer=False), dedup.title_segments(titles))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r["x"], r["y"]) for r in pairs.collect()] == [("effects of aspirin on adults with fever", "effects of aspirin on adults with fevers")]


@pytest.mark.parametrize("ranker", [learning.logistic, learning.linear_svm])
def test_linear_rankers_weigh_only_what_their_examples_have(spark, ranker):
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.linalg import Vectors

    draw, size = random.Random(2), 1 << 18
    rows = [(i, Vectors.sparse(size, sorted((draw.randrange(60) * 4000 + 1000 * (i % 2) + j, draw.random() + 0.1) for j in range(5))), float(i % 2)) for i in range(80)]
    rows = spark.createDataFrame([*rows, (80, Vectors.sparse(size, [], []), 0.0)], ["pmid", "features", "label"])
    train, rest = rows.where("pmid < 40").select("features", "label"), rows.select("pmid", "features", F.col("label").cast("int").alias("rel"))
    model = ranker()(train)
    assert isinstance(model, learning.SparseLinear) and np.count_nonzero(model.weights) <= 200
    whole = (LogisticRegression(regParam=1 / 40, maxIter=50) if ranker is learning.logistic else LinearSVC(regParam=1 / 40, maxIter=30)).fit(train)
    got, want = ({r["pmid"]: r["p"] for r in learning._scored(rest, m, 1).collect()} for m in (model, whole))
    assert got == pytest.approx(want, abs=1e-4) and len(got) == 81


def test_json_replies(spark):
    rows = _one(spark, '{"satisfies": true}', 'text\n```json\n{"satisfies": "false"}\n```', "nothing").select(votes.parse_vote(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["Include", "Exclude", "Uncertain"]
    pair = _one(spark, 'x "pubmed_query": "a", "s2_query": "b"', '{"pubmed_query": "a"}').select(review.query_pair(F.col("x"))).collect()
    assert tuple(pair[0][0]) == ("a", "b") and pair[1][0] is None


def test_sections(spark):
    text = "intro\nMethods\nm one\nRESULTS:\nr\nMethods\nm two"
    r = _one(spark, text).select(tx.text_sections(F.col("x")).alias("s")).select("s", tx.parse_quality(F.col("s")), review.section_with(F.lit("m two"), F.col("s"))).first()
    assert r[0] == {"OTHER": "intro", "METHODS": "m one\n\nm two", "RESULTS": "r"} and r[1] == 1.0 and r[2] == "METHODS"


def test_majority_rules(spark):
    cases = {"a": "IIIII", "b": "IIIEE", "c": "IIEEU", "d": "IIEE", "e": "UUUUU"}
    name = {"I": "Include", "E": "Exclude", "U": "Uncertain"}
    df = spark.createDataFrame([(k, name[v]) for k, vs in cases.items() for v in vs], "pmid string, vote string")
    got = {r.pmid: (r.majority, r.u, r.y_hat) for r in votes.majority(df, ["pmid"]).collect()}
    assert got == {"a": ("Include", 1.0, 1), "b": ("Include", 0.6, 1), "c": ("Uncertain", 0.0, 0), "d": ("Uncertain", 0.0, 0), "e": ("Uncertain", 0.0, 0)}
    merged = votes.merge_scores(spark.createDataFrame([("a", 0.3), ("z", 0.4)], "pmid string, s double"), votes.majority(df, ["pmid"], 5)).collect()
    assert {r.pmid: (r.u, r.y_hat) for r in merged} == {"a": (1.0, 1), "z": (0.4, 0)}


def test_store_semantics(spark):
    v = spark.createDataFrame([("a", 1, 2, "new"), ("a", 1, 1, "old"), ("b", 1, 1, "{}"), ("c", 1, 1, None)], "pmid string, seed_b int, created_at int, response string")
    first = {r.pmid: r.response for r in stores.first_votes(v, ["pmid", "seed_b"], "created_at").collect()}
    assert first["a"] == "old" and {r.response for r in stores.latest(v, "pmid", "created_at").where("pmid = 'a'").collect()} == {"new"}
    assert {r.pmid for r in stores.without_empty(v).collect()} == {"a"}


def test_qrels(spark, tmp_path):
    (tmp_path / "q").write_text("# c\nT1 0 5 1\n\nT1 0 6 0\nT2 0 7 1\nT1 0 6 1\n")
    assert {(r.pmid, r.rel) for r in judgments.topic_qrels(spark, str(tmp_path / "q"), "T1").collect()} == {("5", 1), ("6", 1)}
    (tmp_path / "bad").write_text("T1 0 5 2\n")
    with pytest.raises(Exception, match="bad line"):
        judgments.strict_qrels(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "len").write_text("T1 0 5 2\nshort\nT1 0 6 1 extra\n")
    assert {(r.pmid, r.rel) for r in judgments.lenient_qrels(spark, str(tmp_path / "len")).collect()} == {("5", 0), ("6", 1)}
    (tmp_path / "topic").write_text("Topic: X\n\nTitle: A title\n\nQuery:\na and\nb\n\nPids:\n    11\n    x\n    12\n")
    t = judgments.topic_file(spark, str(tmp_path / "topic")).first()
    assert (t.title, t.query, t.pmids) == ("A title", "a and b", ["11", "12"])


def test_run_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("T", "a", 1, True), ("T", "b", 2, False)], "topic_id string, pmid string, rank int, assessed boolean")
    judgments.write_run(df, str(tmp_path / "run"))
    assert [(r.action, r.pmid, r["rank"], r.score) for r in judgments.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()] == [("AF", "a", 1, 0.0), ("NF", "b", 2, -1.0)]


def test_protocol_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"title": "t", "pico": {"population": "adults"}, "inclusion_criteria": [{"criterion_id": "c", "text": "x", "type": "odd"}]}, indent=1))
    p = stores.load_protocol(spark, str(tmp_path / "p.json")).first()
    assert p.inclusion_criteria[0].type == "MANDATORY" and p.pico.study_design == "RCT" and p.exclusion_criteria == []
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A <i>b</i></ArticleTitle><Abstract><AbstractText>c</AbstractText><AbstractText>d</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    r = judgments.article_records(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.pmid, r.title, r.abstract) == ("7", "A b", "c d")
    body = "<article><abstract>s</abstract><body><sec sec-type='methods'><title>M</title><p>how</p></sec><sec><title>Key findings</title><p>what</p></sec></body></article>"
    got = {(x.label, x.text) for x in review.article_sections(spark.createDataFrame([(1, body), (2, "<bad"), (3, None)], "id long, xml string"), "id").collect()}
    assert got == {("ABSTRACT", "s"), ("METHODS", "M how"), ("RESULTS", "Key findings what")}


def test_bm25_matches_definition(spark):
    import math

    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "banana durian elder"), (4, "fig")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ranking.bm25(df, tx.tokens(F.col("text")), ["apple", "banana", "banana", "none"]).collect()}
    words = {d: t.split() for d, t in docs}
    n, avg = 4, sum(map(len, words.values())) / 4
    df_ = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    for d, x in words.items():
        want = sum(idf.get(q, 0) * x.count(q) * 2.5 / (x.count(q) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for q in ["apple", "banana", "banana", "none"])
        assert got[d] == pytest.approx(want)


def test_greedy_dedup_is_not_transitive(spark):
    titles = ["a study of effects in adult patients with asthma", "a study of effects in adult patients with asthmas", "other title entirely here", None]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(titles)] + [(4, "x", "10.1/a", None), (5, "y", "https://doi.org/10.1/A", None)], "seq long, title string, doi string, pmid string")
    assert dict(map(tuple, dedup.deduplicate(df, "seq").collect())) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
    doi, pmid = [(0, "10.1/a", None), (1, "10.1/a", "9"), (2, None, "9"), (3, None, "9")], "seq long, doi string, pmid string"
    assert dict(map(tuple, dedup.deduplicate(spark.createDataFrame(doi, pmid), "seq", fuzzy=False).collect())) == {0: 0, 1: 0, 2: 2, 3: 2}, "only records that stay hold keys"


def _record_rows(n=220):
    draw = random.Random(21)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(40)).strip() for _ in range(12)]
    rows = []
    for i in range(n):
        title = draw.choice(base)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(title))
            title = title[:at] + draw.choice(["", "x", "yz"]) + title[at + draw.randrange(2):]
        rows.append((i, draw.choice([None, "", title, title]), draw.choice([None, "", f"10.1/{draw.randrange(60)}", f"https://doi.org/10.1/{draw.randrange(60)}"]), draw.choice([None, "", str(draw.randrange(60))])))
    return rows


def _in_order(rows, fuzzy):
    want, held = {}, {"d": {}, "p": {}, "t": {}}
    for i, title, doi, pmid in rows:
        d, p = (doi or "").replace("https://doi.org/", ""), pmid or ""
        t = None if title is None else " ".join(title.split())
        found = held["d"].get(d) if d else None
        found = held["p"].get(p) if found is None and p else found
        if found is None and t is not None:
            found = next((k for x, k in held["t"].items() if x == t or fuzzy and x and t and indel_ratio(x, t) >= 0.95), None)
        want[i] = i if found is None else found
        if found is None:
            held["d"] |= {d: i} if d else {}
            held["p"] |= {p: i} if p else {}
            held["t"] |= {t: i} if t is not None else {}
    return want


@pytest.mark.parametrize(("fuzzy", "component"), [(False, 100_000), (True, 100_000), (True, 3)])
def test_dedup_equals_a_pass_in_order(spark, fuzzy, component):
    rows = _record_rows()
    df = spark.createDataFrame(rows, "seq long, title string, doi string, pmid string").repartition(3)
    want = _in_order(rows, fuzzy)
    assert dict(map(tuple, dedup.deduplicate(df, "seq", fuzzy, component).collect())) == want
    assert 20 < sum(k == v for k, v in want.items()) < 200
    if component == 3:  # components alone, without a round before them
        triples = dedup._triples(dedup._rows(df, "seq"), "seq")
        near = dedup.near_titles(dedup.title_probes(dedup._titles(triples), longer=False), dedup.title_segments(dedup._titles(triples)))
        stay = {r["seq"] for r in dedup.decide(triples, near, "seq", rounds=0).collect()}
        assert stay == {k for k, v in want.items() if k == v and any(x is not None and (x != "" or i == 0) for i, x in enumerate(rows[k][1:]))}


def test_rounds_of_dedup_equal_one_run(spark):
    rows = _record_rows(150)
    index, got = dedup.RecordIndex(spark, "seq"), {}
    for low, high in ((0, 60), (60, 100), (100, 150)):
        part = spark.createDataFrame(rows[low:high], "seq long, title string, doi string, pmid string").repartition(2)
        got |= dict(map(tuple, index.add(part).collect()))
    assert got == _in_order(rows, True)
    assert {r["seq"] for r in index._held("keys").collect()} == {k for k, v in got.items() if k == v and any(x is not None and x != "" or i == 0 and x is not None for i, x in enumerate(rows[k][1:]))}


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    landed, names = dedup.landed, []
    monkeypatch.setattr(dedup, "landed", lambda df, name: (names.append(name), landed(df, name))[1])
    edges = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = dict(map(tuple, dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert len({got[i] for i in range(401)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1 and got[0] != got[1000] and 5000 not in got
    assert names.count("components-parents") <= 16  # a chain in order would take 400 rounds by its smallest numbers


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.8, 0.6])
def test_similar_titles_are_all_pairs(spark, threshold):
    draw = random.Random(4)
    titles = ["data base systems", "database systems", "electroencephalography", "electroencephalographi", "a" * 40, "a" * 38, "ab" * 20, "ab" * 19, "x", "xy", "abcdefghij", "abcdefghijk", "0123456789abcdefghi", "0123456789abcdefghijk", "été à la plage municipale", "ete à la plage municipale"]
    for _ in range(25):
        title = " ".join("".join(draw.choice("abcdef") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 12)))
        titles.append(title)
        for edits in (1, 2, 4):
            chars = list(title)
            for _ in range(edits):
                at = draw.randrange(len(chars) + 1)
                chars[at:at + draw.randrange(2)] = draw.choice(["", " ", "f", "z"])
            titles.append("".join(chars))
    df = dedup.keyed(spark.createDataFrame(list(enumerate(titles)), "seq long, title string"))
    keys = {}
    for r in df.orderBy("seq").collect():
        if r["title_key"]:
            keys.setdefault(r["title_key"], r["seq"])
    want = {(min(keys[x], keys[y]), max(keys[x], keys[y])) for x in keys for y in keys if x < y and indel_ratio(x, y) >= threshold}
    got = [(r["u"], r["v"]) for r in dedup.similar_titles(df, "seq", threshold).collect()]
    assert sorted(got) == sorted(want) and {(0, 1), (2, 3), (4, 5), (6, 7), (10, 11), (12, 13)} <= want


def test_active_learning_goes_on_until_its_rule_holds(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(150).select(F.col("id").alias("pmid"), array_to_vector(F.array(F.sin("id"), F.cos("id"))).alias("features"), (F.col("id") % 10 == 0).cast("int").alias("rel"))
    log = learning.autotar(df, batch=5).orderBy("round").collect()
    assert tuple(log[-1])[1:] == (150, 15, None) and [r["round"] for r in log] == list(range(len(log)))
    part = [r["assessed"] for r in learning.autotar(df, stop_share=0.3, batch=20).orderBy("round").collect()]
    assert part[-1] >= 45 > part[-2]


def test_splits_are_nested_and_stratified(spark):
    df = spark.createDataFrame([("t", i, i / 400, int(i % 8 == 0)) for i in range(400)], "topic_id string, pmid long, s double, y int").withColumn("u", F.lit(0.5))
    split = splits.three_way_split(df)
    counts = {(r.y, r.is_split): r["count"] for r in split.groupBy("y", "is_split").count().collect()}
    assert counts == {(1, 0): 8, (1, 1): 25, (1, 2): 17, (0, 0): 53, (0, 1): 175, (0, 2): 122}
    few, more = ({r.pmid for r in splits.subsample_positives(split, m).where("is_split = 1 AND y = 1").collect()} for m in (5, 12))
    assert len(few) == 5 and len(more) == 12 and few < more
    flat = df.withColumn("s", F.lit(0.4))
    assert {r.s for r in splits.quantile_scale(flat).collect()} == {0.4}


def test_routing_crossed_thresholds(spark):
    df = spark.createDataFrame([("t", 1, 0.5, 0.2, 1, 0), ("t", 2, 0.1, 0.9, 1, 1), ("t", 3, 0.95, 0.9, 0, 0)], "topic_id string, pmid long, s double, u double, y int, y_hat int")
    theta = spark.createDataFrame([("t", 0.6, 0.4, 0.5)], "topic_id string, lambda_lo double, lambda_hi double, tau double")
    assert {r.pmid: r.route for r in routing.routed(df, theta).collect()} == {1: "auto_accept", 2: "auto_reject", 3: "auto_accept"}
    r = routing.evaluate(routing.routed(df, theta)).first()
    assert r.fnr == 0.5 and r.wss is None and r.n_auto_reject == 1


def test_crc_threshold_ranks_by_buckets(spark):
    draw = random.Random(8)
    scores = {t: [round(draw.random(), 3) for _ in range(n)] for t, n in (("a", 1500), ("b", 40), ("c", 3))}
    df = spark.createDataFrame([(t, s) for t, own in scores.items() for s in own], "topic_id string, s double")
    found = baselines.crc_threshold(df, 0.1, ["topic_id"])
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", found._jdf.queryExecution().analyzed().toString())
    assert windows and all("__b#" in w for w in windows)
    places = {t: math.floor(0.1 * (len(own) + 1) + 1e-12) - 1 for t, own in scores.items()}
    assert {r["topic_id"]: r["lambda_star"] for r in found.collect()} == {t: sorted(own)[places[t]] if places[t] >= 0 else 0.0 for t, own in scores.items()}
    assert baselines.crc_threshold(df.limit(0), 0.1, ["topic_id"]).count() == 0


def test_crc_threshold(spark):
    df = spark.createDataFrame([("t", i / 10) for i in range(1, 21)], "topic_id string, s double")
    assert baselines.crc_threshold(df, 0.10, ["topic_id"]).first().lambda_star == pytest.approx(0.2)
    assert baselines.crc_threshold(df.limit(5), 0.05, ["topic_id"]).first().lambda_star == 0.0


def test_ranked_measures(spark):
    run = spark.createDataFrame([("T", f"d{i:02}", i) for i in range(1, 21)], "topic_id string, pmid string, rank int")
    qrels = spark.createDataFrame([("T", "d01", 1), ("T", "d04", 1), ("T", "d05", 2), ("T", "d06", 3)], "topic_id string, pmid string, rel int")
    rows = evaluator.judged_run(run, qrels)
    r = evaluator.measures(rows).first()
    assert r.n_docs == 19 and r.n_rel == 3 and r.ap == pytest.approx((1 + 2 / 4 + 3 / 5) / 3) and r.last_rel == 5
    assert [x.gain for x in evaluator.decile_gain(rows).orderBy("decile").collect()][:5] == pytest.approx([1 / 3, 1 / 3, 1 / 3, 2 / 3, 1])


def test_rules(spark):
    df = spark.createDataFrame([("t", "s", 2020), (" ", "s", 999), ("t", None, None)], "title string, source_database string, year int")
    assert tuple(review.check(df, "candidate").first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        review.check_budget(0.03, 0.08, 0.10)


def test_event_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"ts": "2024-01-01T00:00:00Z", "type": "screening.route_decision" if i % 2 else "pipeline.stage_complete", "pmid": str(i)}) for i in range(40)))
    q = events.stage_counts(events.feed(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.type, r.n) for r in spark.sql("SELECT * FROM counts").collect()} == {("screening.route_decision", 20), ("pipeline.stage_complete", 20)}
    q = events.every_tenth(events.feed(spark, str(folder))).writeStream.outputMode("append").format("memory").queryName("tenth").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.type, r.seen) for r in spark.sql("SELECT * FROM tenth").collect()) == [("pipeline.stage_complete", 10), ("pipeline.stage_complete", 20), ("screening.route_decision", 10), ("screening.route_decision", 20)]
    assert events.messages(spark.read.schema(events.SCHEMA).json(str(folder))).count() == 40


def test_staged_run_resumes(spark, tmp_path):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    first = screening_run.run(spark, folder, str(tmp_path)).collect()
    stamp = os.path.getmtime(tmp_path / "scores" / "_SUCCESS")
    again = screening_run.run(spark, folder, str(tmp_path)).collect()
    assert sorted(first, key=str) == sorted(again, key=str) and os.path.getmtime(tmp_path / "scores" / "_SUCCESS") == stamp
    assert {r.status for r in screening_run.preflight(spark.read.parquet(f"{tmp_path}/scores")).collect()} == {"PASS"}
