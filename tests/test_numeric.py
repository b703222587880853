import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import numeric as nm
from sievework.operators import certify

from .plain import plain_betting_bound


def _binomial_cdf(k, n, p):
    return math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_and_hb(spark):
    rows = [(k, n, p) for n in (1, 5, 59, 251) for k in (0, 1, n // 3, n) for p in (0.01, 0.1, 0.35)]
    df = spark.createDataFrame(rows, "k int, n int, p double")
    for r in df.select("*", nm.binomial_cdf(F.col("k"), F.col("n"), F.col("p")).alias("c"), nm.hb_pvalue(F.col("k"), F.col("n"), F.col("p")).alias("h")).collect():
        cdf = _binomial_cdf(r.k, r.n, r.p)
        assert r.c == pytest.approx(cdf, rel=1e-9)
        a = min(r.k / r.n, r.p)
        kl = (a * math.log(a / r.p) if a else 0) + (1 - a) * math.log((1 - a) / (1 - r.p))
        assert r.h == pytest.approx(min(math.exp(-r.n * kl), math.e * cdf), rel=1e-9)


def test_intervals():
    low, high = nm.clopper_pearson(3, 59)
    assert _binomial_cdf(3, 59, high) == pytest.approx(0.025, abs=1e-9) and 1 - _binomial_cdf(2, 59, low) == pytest.approx(0.025, abs=1e-9)
    assert nm.clopper_pearson(0, 10)[0] == 0 and nm.clopper_pearson(10, 10)[1] == 1 and nm.clopper_pearson(0, 0) == (0.0, 1.0)
    assert nm.inverse_normal(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_n_min(spark):
    assert spark.range(1).select(nm.n_min(0.10, 0.07)).first()[0] == 26


@given(st.lists(st.integers(0, 1), min_size=1, max_size=80))
@settings(max_examples=40, deadline=None)
def test_betting_bound_is_a_bound(x):
    bound = nm.betting_lower_bound(np.array(x, float), 0.05)
    assert 0 <= bound <= 1 and (bound == 0 or sum(x) > 0)


@pytest.mark.parametrize("strategy", ["prpl", "ons"])
def test_betting_bound_equals_the_plain_search(strategy):
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 130):
        for share in (0.0, 0.2, 0.7, 1.0):
            x = (draw.random(n) < share).astype(float)
            assert nm.betting_lower_bound(x, 0.05, strategy, 20) == pytest.approx(plain_betting_bound(list(x), 0.05, strategy, 20), abs=1e-9)
    assert nm.betting_lower_bound(np.array([]), 0.05, strategy) == 0


def test_betting_bound_covers():
    draw = np.random.default_rng(1)
    misses = sum(nm.betting_lower_bound((draw.random(60) < 0.3).astype(float), 0.05) > 0.3 for _ in range(150))
    assert misses <= 15


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=60, deadline=None)
def test_indel_ratio(a, b):
    r = nm.indel_ratio(a, b)
    assert 0 <= r <= 1 and r == nm.indel_ratio(b, a) and (r == 1) == (a == b)


def _running_example(n=10_000, seed=0):
    draw = np.random.default_rng(seed)
    y = (draw.random(n) < 0.05).astype(int)
    pos, neg = draw.beta(8, 2, n), draw.beta(2, 8, n)
    s, u = np.where(y == 1, pos, neg), draw.beta(5, 5, n)
    y_hat = np.where((draw.random(n) < 0.10) & (s >= 0.3) & (s <= 0.7), 1 - y, y)
    calib, split = np.zeros(n, bool), np.random.default_rng(20260429)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        calib[split.choice(at, len(at) // 2, replace=False)] = True
    return s, u, y, y_hat, calib


def _rows(spark, n):
    s, u, y, y_hat, calib = _running_example(n)
    data = [("t", int(i) + 1, float(s[i]), float(u[i]), int(y[i]), int(y_hat[i])) for i in np.flatnonzero(calib)]
    return spark.createDataFrame(data, "topic_id string, pmid long, s double, u double, y int, y_hat int")


@pytest.mark.parametrize(("k", "k_tau", "certified", "theta"), [(20, 20, 4199, (0.42193896, 0.58843085, 0.47368421)), (20, 5, 1045, (0.42193896, 0.58843085, 0.5)), (10, 5, 315, (0.41466646, 0.98908536, 0.75))])
def test_golden_certificate(spark, k, k_tau, certified, theta):
    r = certify.certify(_rows(spark, 10_000), k=k, k_tau=k_tau).first()
    assert (r.status, r.m_plus, r.n_certified) == ("certified", 251, certified)
    assert r.eta == pytest.approx(0.00983, abs=5e-6)
    assert (r.lambda_lo, r.lambda_hi, r.tau) == pytest.approx(theta, abs=1e-7)


def test_histogram_equals_direct_counts(spark):
    s, u, y, y_hat, calib = _running_example(1500)
    rows = spark.createDataFrame([("t", i, float(a), float(b), int(c), int(d)) for i, (a, b, c, d) in enumerate(zip(s[calib], u[calib], y[calib], y_hat[calib], strict=True))], "topic_id string, pmid long, s double, u double, y int, y_hat int")
    points = certify.breakpoints(rows, 10)
    got = certify.grid_risks(certify.theta_grid(points, 5), certify.histogram(rows, points, 5)).collect()
    s, u, y, y_hat = s[calib], u[calib], y[calib], y_hat[calib]
    assert len(got) > 300
    for r in got:
        band = (s >= r.lambda_lo) & (s < r.lambda_hi)
        assert r.n_miss == ((y == 1) & ((s < r.lambda_lo) | (band & (u >= r.tau)))).sum()
        assert r.n_slack == ((y == 1) & band & (u >= r.tau) & (y_hat == 1)).sum()
        assert r.cost == pytest.approx((5 * (s >= r.lambda_hi).sum() + 0.001 * band.sum() + 5 * (band & (u < r.tau)).sum()) / len(s))


def test_risks_of_few_cells(spark):
    """Topics whose rows leave most of the table empty: none below the first breakpoint, none sure, a single row."""
    rows = [("one", 1, 0.5, 0.5, 1, 1), ("unsure", 1, 0.2, 0.0, 1, 1), ("unsure", 2, 0.9, 0.1, 0, 0), ("top", 1, 1.0, 1.0, 1, 0), ("top", 2, 0.0, 1.0, 1, 1), ("top", 3, 0.0, 0.3, 0, 1)]
    df = spark.createDataFrame(rows, "topic_id string, pmid long, s double, u double, y int, y_hat int")
    points = certify.breakpoints(df, 4)
    got = certify.grid_risks(certify.theta_grid(points, 3), certify.histogram(df, points, 3)).collect()
    assert {r.topic_id for r in got} == {"one", "unsure", "top"}
    for r in got:
        own = [x for x in rows if x[0] == r.topic_id]
        band = [x for x in own if r.lambda_lo <= x[2] < r.lambda_hi]
        assert (r.m_plus, r.n_all, r.n_band, r.n_accept) == (sum(x[4] for x in own), len(own), len(band), sum(x[2] >= r.lambda_hi for x in own))
        assert r.n_miss == sum(x[4] for x in own if x[2] < r.lambda_lo) + sum(x[4] for x in band if x[3] >= r.tau)
        assert (r.n_human, r.n_slack) == (sum(x[3] < r.tau for x in band), sum(x[4] * x[5] for x in band if x[3] >= r.tau))


def test_walks_and_holm(spark):
    p = [0.001, 0.001, 0.5, 0.001]
    rows = spark.createDataFrame([("t", i, float(i), 1.0, 0.0, x) for i, x in enumerate(p)], "topic_id string, theta_idx int, lambda_lo double, lambda_hi double, tau double, p double")
    assert [r.certified for r in certify.walk(rows, 0.07, "safest").orderBy("theta_idx").collect()] == [True, True, False, False]
    assert [r.certified for r in certify.walk(rows, 0.07, "riskiest").orderBy("theta_idx").collect()] == [False, False, False, True]
    assert [r.certified for r in certify.holm(rows, 0.07).orderBy("theta_idx").collect()] == [True, True, False, True]


def test_too_few_positives_abstain(spark):
    rows = spark.createDataFrame([("t", i, i / 100, 0.5, int(i < 20), 1) for i in range(100)], "topic_id string, pmid long, s double, u double, y int, y_hat int")
    r = certify.certify(rows).first()
    assert r.status == "abstained" and r.theta_idx is None
