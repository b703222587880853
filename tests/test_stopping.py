"""Knees, stopping policies, joint inclusion probabilities and sweeps against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.numeric import knee
from sievework.operators import baselines, learning, stopping, sweeps

from .plain import plain_joint_variances, plain_knees, plain_run

#: The published examples and their knees.
ONE = [(0, 0), (0.1, 0.55), (0.2, 0.75), (0.35, 0.825), (0.45, 0.875), (0.55, 0.9), (0.675, 0.925), (0.775, 0.95), (0.875, 0.975), (1, 1)]
TWO = [(0, 0), (0.1, 0.0), (0.2, 0.0), (0.35, 0.1), (0.45, 0.1), (0.55, 0.1), (0.675, 0.2), (0.775, 0.2), (0.875, 0.2), (1, 1)]


def test_knees_of_the_published_examples(spark):
    assert [ONE[i] for i in knee(*zip(*ONE), sensitivity=1)] == [(0.2, 0.75)]
    assert [TWO[i] for i in knee(*zip(*TWO), sensitivity=1)] == [(0.45, 0.1), (0.775, 0.2)]
    rows = spark.createDataFrame([("a", *map(float, p)) for p in ONE] + [("b", *map(float, p)) for p in TWO], "topic_id string, x double, y double")
    got = sorted(map(tuple, stopping.knee_points(rows, "x", "y", sensitivity=1).collect()))
    assert got == [("a", 0.2, 0.75), ("b", 0.45, 0.1), ("b", 0.775, 0.2)]


def _curves(seed, n):
    draw = random.Random(seed)
    for _ in range(n):
        x = y = 0
        points = []
        for _ in range(draw.randrange(1, 60)):
            x, y = x + draw.randrange(1, 40), y + draw.randrange(0, 12) * (draw.random() < 0.5)
            points.append((x, y))
        yield points


def test_knees_equal_a_plain_version(spark):
    curves = [*_curves(1, 60), [(1, 1)], [(1, 0), (2, 0)], [(1, 0), (2, 0), (3, 0)], [(i, i) for i in range(1, 9)]]
    rows = spark.createDataFrame([(f"c{k}", float(a), float(b)) for k, c in enumerate(curves) for a, b in c], "topic_id string, x double, y double")
    some = 0
    for window, sensitivity in ((1, 0.01), (1, 0.002), (2, 0.01), (3, 0.005)):
        want = {f"c{k}": [c[i] for i in plain_knees(c, window, sensitivity)] for k, c in enumerate(curves)}
        some += sum(map(len, want.values()))
        assert {f"c{k}": [c[i] for i in knee(*zip(*c), window, sensitivity)] for k, c in enumerate(curves)} == want
        got = sorted(map(tuple, stopping.knee_points(rows, "x", "y", window=window, sensitivity=sensitivity).collect()))
        assert got == sorted((k, float(a), float(b)) for k, own in want.items() for a, b in own)
    assert some > 100


def test_knee_stop_keeps_the_ratio_of_its_first_knee(spark, monkeypatch):
    # (assessed, found) rounds: the first knee shows at 150 found, so the ratio stays 6 though it would rise no more
    seen = []

    def rounds(docs, batch, growth, seed, choose, done, **settings):
        log = []
        for i, (n, r) in enumerate([(10, 2), (20, 60), (40, 80), (80, 81), (160, 81), (320, 81), (640, 81)]):
            log.append((i, n, r))
            seen.append(done(log)[1])
        return log

    monkeypatch.setattr(learning, "loop", rounds)
    found = []
    monkeypatch.setattr(learning, "knee_slopes", lambda log: found.append(len(log)) or (None if len(log) < 3 else {3: 70.0, 4: 75.0, 5: 76.5, 6: 80.0, 7: 90.0}[len(log)]))
    learning.knee_stop(None, least=100)
    # set at the third round: 156 - 80 = 76; 76.5 with 160 assessed is the first above it
    assert seen == [False, False, False, False, True, True, True]


def test_batches_grow_and_points_add_up(spark):
    assert stopping.batch_ends(20) == [1, 3, 6, 10, 15, 20] and stopping.batch_ends(7, 3, 0) == [3, 6, 7]
    rel = [1, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    rows = spark.createDataFrame([("t", i + 1, r) for i, r in enumerate(rel)] + [("u", 1, 1)], "topic_id string, rank int, rel int")
    assert sorted(map(tuple, stopping.gain_points(rows).collect())) == [("t", 1, 1), ("t", 3, 2), ("t", 6, 3), ("t", 10, 4), ("t", 12, 5), ("u", 1, 1)]


def _documents(seed, n, rounds):
    draw = np.random.default_rng(seed)
    p = draw.pareto(1.2, (n, rounds)) + 0.05
    p /= p.sum(axis=0)
    return p, (draw.random(n) < 0.4).astype(int), draw.random(n) < 0.6


@pytest.mark.parametrize("draws", [2, 40, 300])
def test_joint_variances_equal_sums_over_all_pairs(spark, draws):
    p, y, sampled = _documents(draws, 200, 1)
    p[:80] = p[:80].mean()  # documents of equal probability share a cell
    rows = spark.createDataFrame([("t", i, float(p[i, 0]), int(y[i]), bool(sampled[i])) for i in range(200)] + [("u", 0, 0.5, 0, True), ("v", 0, 0.5, 1, True)], "topic_id string, pmid int, p double, rel int, sampled boolean")
    want = plain_joint_variances(p.tolist(), y.tolist(), sampled.tolist(), [draws])
    exact = {r["topic_id"]: tuple(r)[1:] for r in baselines.joint_variances(rows, draws, None).collect()}
    assert exact["t"] == pytest.approx(want, rel=1e-9)
    assert exact["u"] == (0, 0, 0) and exact["v"][2] == 0
    near = {r["topic_id"]: tuple(r)[1:] for r in baselines.joint_variances(rows, draws, 1e-3).collect()}
    assert near["t"] == pytest.approx(want, rel=2e-3)


def test_variance_of_rounds_equals_sums_over_all_pairs(spark):
    p, y, sampled = _documents(3, 200, 4)
    draws = [5, 9, 20, 31]
    want = plain_joint_variances(p.tolist(), y.tolist(), sampled.tolist(), draws)[1]
    rows = spark.createDataFrame([(i, [float(x) for x in p[i]]) for i in range(200) if y[i] and sampled[i]], "pmid long, p array<double>").repartition(3)
    for block in (7, 512):
        assert baselines.history_variance(rows, draws, block) == pytest.approx(want, rel=1e-9)
    assert baselines.history_variance(rows.limit(0), draws) == 0.0


def test_draws_are_in_proportion_to_weights(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK", 16)
    rows = spark.createDataFrame([(i, i + 1, 1.0 / (i + 1)) for i in range(100)], "pmid long, rank long, w double")
    hits = np.zeros(100)
    for s in range(12):
        for r in learning.draw_ranks(rows, 20, f"s{s}").collect():
            hits[r["pmid"]] += 1
    p = 1 / np.arange(1, 101)
    want = 12 * (1 - (1 - p / p.sum()) ** 20)
    assert hits[0] == 12 or hits[0] >= 10
    assert abs(hits.sum() - want.sum()) < 4 * np.sqrt(want.sum()) and abs(hits[50:].sum() - want[50:].sum()) < 4 * np.sqrt(want[50:].sum())


@pytest.mark.parametrize("condition", ["strict1", "strict2"])
def test_strict_rules_wait_for_the_deviation(spark, condition):
    from pyspark.ml.functions import array_to_vector

    docs = spark.range(120).select(F.col("id").alias("pmid"), array_to_vector(F.array(F.when(F.col("id") % 6 == 0, 1.0).otherwise(0.0), F.sin("id"))).alias("features"), (F.col("id") % 6 == 0).cast("int").alias("rel"))
    log = sorted(map(tuple, learning.autostop(docs, 0.9, condition=condition, batch=30, growth=0.8).collect()))
    assert [r[0] for r in log] == list(range(len(log))) and log[0][4] == 0
    stops = [r[2] > 0 and r[2] >= 0.9 * (r[3] + r[4]) for r in log]
    assert not any(stops[:-1]) and (stops[-1] or log[-1][1] == 120)
    assert any(r[4] > 0 for r in log[1:])
    with pytest.raises(ValueError):
        learning.autostop(docs, condition="other")


def test_policy_steps(spark):
    draw = random.Random(9)
    size, topics = 20, []
    for t in range(25):
        n = draw.randrange(5, 400)
        topics += [(f"t{t}", i + 1, int(draw.random() < (0.5 if i < n / 4 else 0.05)) if t else 0, n) for i in range(n)]
    judged = spark.createDataFrame(topics, "topic_id string, rank int, rel int, n_docs int")
    limits = [0.0] * 4 + [0.005 + draw.random() * 0.01 for _ in range(size - 4)]
    table = spark.createDataFrame(list(enumerate(limits)), "location int, threshold double")
    counted = stopping.with_thresholds(stopping.window_counts(judged, size), table)
    got = {r["topic_id"]: r for r in stopping.follow(counted, stopping.threshold_policy(3), 0.8, size).collect()}

    def policy(state, at):
        seen = state[max(0, at - 2): at + 1]
        return sum(seen) / len(seen) < limits[at]

    ends = set()
    for t in range(25):
        own = [r for r in topics if r[0] == f"t{t}"]
        width = max(1, len(own) // size)
        parts = [own[i * width:(i + 1) * width] for i in range(size)]
        hits, sizes = [sum(r[2] for r in p) for p in parts], [len(p) for p in parts]
        at, steps, stop, last, total, examined = plain_run([h / size for h in hits], hits, sizes, policy, 0.8, size)
        r = got[f"t{t}"]
        assert (r["location"], r["steps"], r["stopped"], r["examined"]) == (at, steps, stop, examined)
        assert (r["reward"], r["total_reward"]) == (pytest.approx(last), pytest.approx(total)) if t else (r["reward"], r["target"]) == (None, None)
        ends.add(stop)
    assert ends == {True, False}


def test_sweep_of_a_short_ranking(spark):
    rel = [1, 1, 0, 0, 1, 0, 0, 0]
    judged = spark.createDataFrame([("t", i + 1, r, 8, 3) for i, r in enumerate(rel)] + [("none", i + 1, 0, 2, 0) for i in range(2)], "topic_id string, rank int, rel int, n_docs int, n_rel int")
    rows = {(r["topic_id"], r["method"], r["target_recall"]): (r["examined"], r["recall_achieved"], r["wss_status"]) for r in sweeps.recall_sweep(sweeps.stops(judged, {"ones": (1, 0.0), "twos": (2, 0.0), "four": (4, 0.0)}), [0.5, 1.0]).collect()}
    assert rows["t", "ones", 0.5] == (2, pytest.approx(2 / 3), "recall_missed") and rows["t", "ones", 1.0] == (5, 1, "ok")
    assert rows["t", "twos", 1.0] == (6, 1, "ok") and rows["t", "four", 1.0] == (8, 1, "ok") and rows["t", "all", 0.5] == (8, 1, "ok")
    assert rows["t", "windows", 1.0] == (5, 1, "ok") and rows["none", "twos", 1.0] == (2, None, "no_positives")
    assert sweeps.stops(judged.limit(0)).collect() == []
