"""Runs of failures over block borders, templates, and judgments by criterion."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import replies, retrieval, screening


def test_failure_runs_cross_blocks(spark):
    draw = random.Random(6)
    topics = {f"t{i}": [draw.random() < p for _ in range(draw.randrange(1, 120))] for i, p in enumerate([0.2, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0] * 6)}
    topics |= {"all": [True] * 40, "nine": [True] * 9 + [False] + [True] * 9, "ten": [False] * 7 + [True] * 10 + [False], "none": [False] * 30}
    rows = spark.createDataFrame([(t, 3 * i + 5, f) for t, own in topics.items() for i, f in enumerate(own)], "topic_id string, seq long, failed boolean").repartition(3)
    for block in (1, 4, 7, 15, 4096):
        got = {r["topic_id"]: r for r in replies.failure_runs(rows, 10, block=block).collect()}
        for t, own in topics.items():
            run, at = 0, None
            for i, f in enumerate(own):
                run = run + 1 if f else 0
                if run >= 10:
                    at = i
                    break
            seen = own if at is None else own[: at + 1]
            r = got[t]
            assert (r["total"], r["processed"], r["failed"], r["aborted"], r["aborted_at"]) == (len(own), len(seen), sum(seen), at is not None, None if at is None else 3 * at + 5), (t, block)


def test_a_changed_template_is_an_error(spark):
    rows = spark.createDataFrame([("a", None), ("b", "")], "topic_id string, template_sha string")
    assert {r["template_status"] for r in replies.require_template(rows, "template_sha", "x").collect()} == {"unrecorded"}
    made = rows.withColumn("template_sha", F.sha2(F.lit("x"), 256))
    assert {r["template_status"] for r in replies.require_template(made, "template_sha", "x").collect()} == {"ok"}
    with pytest.raises(ValueError):
        replies.require_template(made, "template_sha", "y")


def test_judgments_are_capped_and_verified(spark):
    text = "The adults were treated twice. Nothing else was said."
    rows = spark.createDataFrame([(1, True, 0.9, "adults were treated", text), (2, False, 0.9, "", text), (3, False, 0.2, None, text), (4, True, 0.8, "a phrase of another text altogether", text), (5, None, None, "ADULTS", text)], "i int, satisfies boolean, confidence double, span string, text string")
    got = {r["i"]: (round(r["p"], 9), r["hallucinated"]) for r in retrieval.judged(rows).collect()}
    assert got == {1: (0.9, False), 2: (0.1, False), 3: (0.3, False), 4: (0.24, True), 5: (0.3, False)}


def test_documents_without_shared_terms_give_their_first_sentences(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma one. Delta words are here. Alpha beta gamma two."), (2, "Nothing shared at all. Second sentence here. Third sentence here. Fourth one is here."), (3, None), (4, "")], "doc_id int, text string")
    criteria = spark.createDataFrame([(7, "alpha gamma"), (8, "zzz"), (9, None)], "criterion_id int, criterion_text string")
    got = {}
    for r in retrieval.retrieve(docs, criteria, 2).collect():
        got.setdefault((r["doc_id"], r["criterion_id"]), []).append((r["position"], round(r["score"], 3)))
    assert sorted(got[1, 7]) == [(0, 0.707), (2, 0.707)] and sorted(got[2, 7]) == [(0, 0.0), (1, 0.0)]
    assert sorted(got[1, 8]) == sorted(got[1, 9]) == [(0, 0.0), (1, 0.0)] and {d for d, _ in got} == {1, 2}


def test_sentences_meet_criteria_without_a_shuffle(spark):
    draw, words = random.Random(4), [f"word{i}" for i in range(30)]
    texts = {i: [draw.choices(words, k=draw.randrange(2, 7)) for _ in range(n)] for i, n in enumerate((2500, 3, 1, 40))}
    asked = {i: draw.choices([*words, "elsewhere"], k=3) for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join(" ".join(s) + "." for s in own)) for i, own in texts.items()], "doc_id int, text string")
    criteria = spark.createDataFrame([(i, " ".join(q)) for i, q in asked.items()], "criterion_id int, criterion_text string")
    found = retrieval.retrieve(docs, criteria, 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault((r["doc_id"], r["criterion_id"]), {})[r["position"]] = r["score"]
    assert len(got) == len(texts) * len(asked)
    for (d, c), own in got.items():
        if c % 20 == 0:
            rows, q = [Counter(s) for s in texts[d] if len(" ".join(s)) + 1 > 10], Counter(asked[c])
            cosine = [round(sum(r[t] * n for t, n in q.items()) / (math.sqrt(sum(x * x for x in r.values())) * math.sqrt(sum(x * x for x in q.values()))), 12) for r in rows]
            near = sorted(range(len(rows)), key=lambda i: (-cosine[i], i))[:2]
            df, size = Counter(t for r in rows for t in r), [sum(r.values()) for r in rows]
            idf = {t: math.log(len(rows) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
            mean = sum(idf.values()) / len(idf)
            weight = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
            score = [round(sum(weight[t] * r[t] * 2.5 / (r[t] + 1.5 * (0.25 + 0.75 * size[i] * len(rows) / sum(size))) for t in q if r[t]), 12) for i, r in enumerate(rows)]
            best = [i for i in sorted(range(len(rows)), key=lambda i: (-score[i], i))[:2] if score[i] > 0]
            assert own == pytest.approx({i: cosine[i] for i in {*near, *best}}, abs=1e-12), (d, c)


def test_spans_without_enough_of_the_text_are_not_aligned(spark):
    text = "adults were treated twice a day and nothing else was said. " * 60_000
    rows = spark.createDataFrame([(1, "#" * 200, text), (2, "adults were xreated twice a day and nothing", text), (3, "yaD a eciwt detaert erew stluda", "short")], "i int, span string, text string")
    began = time.monotonic()
    assert {r["i"]: r["verified"] for r in screening.verify_spans(rows, "span", "text").collect()} == {1: False, 2: True, 3: False}
    assert time.monotonic() - began < 20  # 35,000 windows of 200 characters, were each aligned
