"""Exact quantiles by buckets, the beta mixture, and topics run side by side."""

import random
import threading

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sievework.operators import certify, learning, review, screening, splits, synthetic
from sievework.plans import record_queries, topic_runs
from sievework.sources import judgments

from .plain import plain_quantile

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.95, 1.0]


def test_quantiles_equal_the_plain_ones(spark):
    draw = random.Random(5)
    rows = [("even", draw.random()) for _ in range(700)] + [("hot", draw.choice([0.5, 0.5, 0.5, draw.random()])) for _ in range(400)]
    rows += [("two", 1.0), ("two", 3.0), ("single", 7.0), ("same", 2.0), ("same", 2.0), ("mixed", None), ("mixed", 4.0), ("mixed", -1.0), ("nulls", None), (None, 1.5), (None, 2.5)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("q", F.lit("clash"))
    for buckets in (2, 16):
        got = {r.k: r.q for r in splits.quantiles(df.where("k is not null"), "v", SHARES, ["k"], buckets).collect()}
        assert set(got) == {k for k, _ in rows if k}
        for k, q in got.items():
            values = [v for name, v in rows if name == k]
            assert (q is None) == (k == "nulls")
            if q:
                assert q == pytest.approx([plain_quantile(values, s) for s in SHARES], abs=1e-12), k
    whole = splits.quantiles(df, "v", SHARES, [], 32).collect()
    assert len(whole) == 1 and whole[0].q == pytest.approx([plain_quantile([v for _, v in rows], s) for s in SHARES], abs=1e-12)
    assert splits.quantiles(df.limit(0), "v", SHARES, ["k"]).collect() == []


def test_thresholds_by_quantiles(spark):
    values = [i / 99 for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert screening.flag_threshold(df).first()[0] == pytest.approx(plain_quantile(values, 0.75))
    many = df.crossJoin(spark.range(40)).select("p")  # 4,000 rows: p75 flags 1,000, p85 600, p90 400
    assert screening.flag_threshold(many).first()[0] == pytest.approx(plain_quantile(sorted(values * 40), 0.95))
    assert screening.flag_threshold(df.limit(0)).first()[0] is None
    r = review.similarity_test(0.99, df.withColumnRenamed("p", "similarity")).first()
    assert (r.low, r.high) == pytest.approx((0.025, 0.975)) and r.above and r.p_value == pytest.approx(0.01)


def test_beta_mixture_has_its_moments(spark):
    df = synthetic.beta_mixture(spark.range(20_000).select(F.lit("t").alias("topic_id"), F.col("id").alias("pmid"))).cache()
    got = df.groupBy("y").agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.var_pop("s").alias("vs"), F.avg("u").alias("u"), F.var_pop("u").alias("vu")).collect()
    by = {r.y: r for r in got}
    assert by[1].n == pytest.approx(1000, abs=130)
    for y, a, b in ((1, 8, 2), (0, 2, 8)):
        spread = a * b / ((a + b) ** 2 * (a + b + 1))
        assert by[y].s == pytest.approx(a / (a + b), abs=4.5 * (spread / by[y].n) ** 0.5) and by[y].vs == pytest.approx(spread, rel=0.2)
        assert by[y].u == pytest.approx(0.5, abs=0.025) and by[y].vu == pytest.approx(1 / 44, rel=0.2)
    flips = df.groupBy(F.col("s").between(0.3, 0.7).alias("inside")).agg(F.avg((F.col("y") != F.col("y_hat")).cast("int")).alias("share")).collect()
    assert {r.inside: r.share for r in flips} == {True: pytest.approx(0.10, abs=0.02), False: 0.0}
    again = synthetic.beta_mixture(spark.range(20_000).repartition(7).select(F.lit("t").alias("topic_id"), F.col("id").alias("pmid")))
    assert again.exceptAll(df).count() == 0, "a row depends on its id alone"
    r = certify.certify(df).first()
    assert r.status == "certified" and r.m_plus == by[1].n and r.n_certified > 100 and 0 < r.eta < 0.05
    assert synthetic.beta_mixture(spark.createDataFrame([(None,), (None,)], "pmid long")).distinct().count() == 1
    assert synthetic.beta_mixture(spark.range(0).withColumnRenamed("id", "pmid")).count() == 0


def test_a_failing_topic_leaves_the_others_committed(spark, tmp_path):
    root, calls, broken = str(tmp_path / "runs"), [], {"b/ad"}

    def rows(spark, topic, done):
        calls.append(("rows", topic))
        assert done == {} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "rows"
        return spark.range(5).withColumn("v", F.col("id") + len(topic))

    def total(spark, topic, done):
        calls.append(("total", topic))
        if topic in broken:
            raise ValueError("no such topic")
        return done["rows"].agg(F.sum("v").alias("v"))

    phases = [topic_runs.Phase("rows", rows, 3), topic_runs.Phase("total", total, 2), topic_runs.Phase("double", lambda s, t, d: d["total"].select((F.col("v") * 2).alias("v")))]
    topics = ["a", "b/ad", "ccc", "a"]

    def run(**how):
        return {(r.topic_id, r.phase): (r.status, r.error) for r in topic_runs.run_topics(spark, topics, phases, root, **how).collect()}

    log = run()
    assert log[("b/ad", "total")] == ("failed", "ValueError: no such topic") and log[("b/ad", "double")] == ("skipped", None)
    assert [log[(t, p)][0] for t in ("a", "ccc") for p in ("rows", "total", "double")] == ["done"] * 6
    assert {(r.topic_id, r.v) for r in topic_runs.gathered(spark, topics, "double", root).collect()} == {("a", 30), ("ccc", 50)}
    assert calls[:3] != calls[3:6] and {p for p, _ in calls[:3]} == {"rows"}, "a phase ends for all before the next one"
    broken.clear()
    calls.clear()
    log = run()
    assert calls == [("total", "b/ad")] and [log[(t, "rows")][0] for t in ("a", "b/ad", "ccc")] == ["kept"] * 3
    assert log[("b/ad", "double")][0] == "done" and topic_runs.gathered(spark, topics, "double", root).count() == 3
    calls.clear()
    assert {s for s, _ in run(resume=False).values()} == {"done"} and len(calls) == 6
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert topic_runs.run_topics(spark, [], phases, root).count() == 0 and topic_runs.gathered(spark, [], "rows", root) is None


def test_articles_are_parsed_by_all_cores_and_three_times_at_most(spark):
    heads = "<MedlineCitation><PMID> <b>1</b>\n2</PMID><PMID>9</PMID></MedlineCitation><ArticleTitle>A &lt;i&gt;b&lt;/i&gt; <i>c</i></ArticleTitle>"
    texts = [f"<a>{heads}<Abstract><AbstractText>x<!-- y -->z</AbstractText><AbstractText>w<b>v</b></AbstractText></Abstract></a>", "<a><ArticleTitle>none</ArticleTitle></a>", "<a><MedlineCitation><PMID>3</PMID></MedlineCitation></a>", None]
    found = judgments.article_records(spark.createDataFrame([(t,) for t in texts], "xml string"))
    assert sorted(map(tuple, found.collect())) == [("1 2", "A b c", "x z w", []), ("3", None, None, [])]
    assert found._jdf.queryExecution().executedPlan().toString().count("Evaluator(") == 3
    whole = record_queries.article_xml(spark, "/root/testdata/sf0.001")
    assert whole.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _examples(spark, n, parts):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], int(i % 7 == 0), i % parts) for i in range(n)]
    return spark.createDataFrame(rows, "pmid long, features array<double>, rel int, part int").withColumn("features", array_to_vector("features"))


def test_a_fit_of_dense_examples_has_tasks_by_their_number(spark):
    seen = []

    class Estimator:
        def fit(self, train):
            seen.append((train.count(), train.rdd.getNumPartitions()))

    train = _examples(spark, 60, 2).select("features", F.col("rel").cast("double").alias("label")).repartition(12)
    learning._fit_linear(lambda n: Estimator(), train)
    assert seen == [(60, 1)]


def test_parts_of_a_collection_run_side_by_side(spark, monkeypatch):
    docs, inner, met = _examples(spark, 120, 2), learning.autostop, threading.Barrier(2)

    def autostop(rows, **settings):
        met.wait(60)  # each waits for the other: one after the other would never get past
        return inner(rows, **settings)

    monkeypatch.setattr(learning, "autostop", autostop)
    got = learning.autostop_collections(docs, "part", recall=0.8, batch=20, growth=0.5).collect()
    want = [(*r, p) for p in (0, 1) for r in inner(docs.where(F.col("part") == p), recall=0.8, batch=20, growth=0.5).collect()]
    assert sorted(map(tuple, got)) == sorted(want) and {r.part for r in got} == {0, 1}
    assert learning.autostop_collections(docs.limit(0), "part").collect() == []


def test_text_learning_cuts_texts_into_terms_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return text

    texts = ["The brown cats, 7 cats of a house", None, "brown houses and cats", "", "house cats"]
    rows = spark.createDataFrame(list(enumerate(texts)), "pmid long, text string").withColumn("text", F.udf(counted)("text"))
    made = learning.tfidf(rows, least=1)
    assert calls.value == len(texts)
    by_text = {r.pmid: r.features for r in made(spark.createDataFrame(list(enumerate(texts)), "pmid long, text string")).collect()}
    terms = learning.kept_terms(spark.createDataFrame(list(enumerate(texts)), "pmid long, text string"))
    assert {r.pmid: r.kept for r in terms.collect()}[0] == ["brown", "cats", "cats", "house"]
    of_terms = made(terms)
    assert of_terms.columns == ["pmid", "features"] and {r.pmid: r.features for r in of_terms.collect()} == by_text and by_text[1].numNonzeros() == 0
