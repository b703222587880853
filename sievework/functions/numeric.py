"""Scalar and vector functions as column expressions, and their NumPy kernels where a column can't do it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast(D) * x.cast(D)))


def unit(v: Column) -> Column:
    """Row vector of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast(D) / F.when(n < 1e-12, F.lit(1.0)).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(D) * y.cast(D)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm vanishes."""
    den = norm(a) * norm(b)
    return F.when(den < 1e-12, F.lit(0.0)).otherwise(dot(a, b) / den)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def p_satisfy(satisfies: Column, confidence: Column) -> Column:
    """Probability that a criterion holds, of a judgment and its confidence."""
    conf, said = clamp(confidence.cast(D)), F.lower(F.trim(satisfies.cast("string")))
    return F.when(said == "true", conf).when(said == "false", F.least(1 - conf, F.lit(0.30))).otherwise(F.lit(0.50))


def noisy_or(p: Column) -> Column:
    """Aggregate: 1 - product(1 - p)."""
    return 1 - F.product(1 - p)


def decide(p: Column) -> Column:
    return F.when(p >= 0.70, "INCLUDE").when(p <= 0.25, "EXCLUDE").otherwise("UNCERTAIN")


def confidence(p: Column) -> Column:
    return F.when(p >= 0.70, p).when(p <= 0.25, 1 - p).otherwise(F.greatest(p, 1 - p))


def n_min(alpha, delta) -> Column:
    """Fewest positives with which a risk of alpha can be certified at all."""
    a, d = (F.lit(x) if isinstance(x, (int, float)) else x for x in (alpha, delta))
    return F.ceil(F.log(1 / d) / -F.log(1 - a)).cast("int")


def kl(a: Column, b: Column) -> Column:
    """Bernoulli divergence a ln(a/b) + (1-a) ln((1-a)/(1-b)), with 0 ln 0 = 0."""
    return F.when(a > 0, a * F.log(a / b)).otherwise(0.0) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - b))).otherwise(0.0)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P[Bin(n, p) <= k] for 0 < p < 1, by the terms' recursion in logarithms."""
    start = F.struct((n * F.log(1 - p)).alias("t"), F.exp(n * F.log(1 - p)).alias("s"))
    terms = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + F.log(p) - F.log(1 - p)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(terms, start, step, lambda acc: acc["s"])
    return F.when(k >= n, 1.0).when(k < 0, 0.0).when(k < 1, F.exp(n * F.log(1 - p))).otherwise(F.least(total, F.lit(1.0)))


def hb_pvalue(misses: Column, n: Column, alpha: Column) -> Column:
    """Hoeffding-Bentkus p-value of a risk estimate misses/n against alpha; may exceed 1."""
    r = F.least(misses / n, alpha)
    return F.least(F.exp(-n * kl(r, alpha)), F.lit(math.e) * binomial_cdf(misses.cast("int"), n, alpha))


def hb_pvalues(misses: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """hb_pvalue() of many numbers of misses at once; from alpha * n misses on the first bound is 1 and the second above it."""
    least = int(math.ceil(alpha * n))
    log = np.concatenate(([n * math.log1p(-alpha)], np.log((n - np.arange(1, least) + 1) / np.arange(1, least)) + math.log(alpha) - math.log1p(-alpha))) if least else np.zeros(1)
    cdf = np.cumsum(np.exp(np.cumsum(log)))
    k = np.asarray(misses, np.int64)
    r = np.minimum(k / n, alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(r > 0, r * np.log(r / alpha), 0.0) + np.where(r < 1, (1 - r) * np.log((1 - r) / (1 - alpha)), 0.0)
    return np.where(k >= least, 1.0, np.minimum(np.exp(-n * kl), math.e * np.minimum(cdf[np.clip(k, 0, len(cdf) - 1)], 1.0)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval; (0, 1) without trials."""
    p, den = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / den, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.when(n == 0, 0.0).otherwise(mid - half), F.when(n == 0, 1.0).otherwise(mid + half)


def incomplete_beta(x: float, a: int, b: int) -> float:
    """Regularised incomplete beta function of whole a and b: P[Bin(a + b - 1, x) >= a]."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    n = a + b - 1
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(x) + (n - i) * math.log1p(-x)) for i in range(a, n + 1))


def beta_quantile(q: float, a: int, b: int) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval."""
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def betting_lower_bound(x: np.ndarray, delta: float, strategy: str = "prpl", breaks: int = 200) -> float:
    """Lower confidence bound of a mean in [0, 1] by predictable betting, at level 2 * delta, sample order mattering.

    Wealth that bets against a mean m is a product of 1 + bet * (x - m); means whose wealth reaches
    1 / (2 * delta) are ruled out. The bound is the largest of those at up to ``breaks`` stops.
    """
    n, level = len(x), 2 * delta
    if n == 0:
        return 0.0
    goal = math.log(1 / level)
    x, t = np.asarray(x, float), np.arange(n)
    # t + 1 times the variance is the larger of (its predecessor + a squared deviation) and a floor: a running maximum
    deviations = np.cumsum((x - np.cumsum(x) / (t + 1)) ** 2)
    spread = deviations + np.maximum.accumulate(np.maximum((t + 1) / (4 * (t + 2)) - deviations, 0.0))
    before = np.concatenate(([0.25], (spread / (t + 1))[:-1]))
    bets = np.minimum(1.0, np.sqrt(2 * math.log(2 / level) / ((t + 1) * np.maximum(before, 1e-10))))
    stops = np.unique(np.round(np.linspace(1, n, min(breaks, n))).astype(int))

    def wealths(m: float, stop: int = n) -> np.ndarray:
        own = bets[:stop] if strategy == "prpl" else newton_bets(x[:stop], m)
        return np.log(np.maximum(1 + own * (x[:stop] - m), 1e-300))

    def largest(low: float, ruled_out) -> float:
        high = 1.0
        for _ in range(60):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (mid, high) if ruled_out(mid) else (low, mid)
        return low

    def reached(m: float) -> np.ndarray:
        return np.cumsum(wealths(m))[stops - 1] >= goal

    if strategy == "prpl":  # bets don't depend on m, so wealth falls with m at every stop: one search does for all of them
        return largest(0.0, lambda m: reached(m).any()) if reached(0.0).any() else 0.0
    best = 0.0
    passes = reached(best)
    for i, stop in enumerate(stops):
        if passes[i]:
            low = largest(best, lambda m, stop=stop: wealths(m, stop).sum() >= goal)
            if low > best:
                best, passes = low, reached(low)
    return best


def newton_bets(x: np.ndarray, m: float) -> np.ndarray:
    """Bets in [0, 0.5] by the diagonal Newton rule: the sum of earlier deviations over one plus the sum of their squares."""
    d = np.asarray(x, float) - m
    before = np.concatenate(([0.0], np.cumsum(d)[:-1])), np.concatenate(([1.0], 1 + np.cumsum(d * d)[:-1]))
    return np.clip(before[0] / before[1], 0.0, 0.5)[:len(d)]


def inverse_normal(q: float) -> float:
    low, high = -12.0, 12.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < q else (low, mid)
    return (low + high) / 2


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length: the similarity whose cost is insertions and deletions."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for ch in a:
        before = 0
        for j, other in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if ch == other else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def knee(x: np.ndarray, y: np.ndarray, window: int = 1, sensitivity: float = 10) -> list[int]:
    """Kneedle: places where the curve (x, y) turns away from its diagonal; x may be uneven.

    Both axes are smoothed over the points from ``window`` before to ``window`` after a point, the last of these
    and the last of all points left out, and scaled to 0..1. A strict maximum of y - x is a knee if, before the next
    one, the difference falls below its own by ``sensitivity`` mean steps; steps count from the first x as given.
    """
    n = len(x)
    if n < 3:
        return []
    points, at = np.stack((np.asarray(x, float), np.asarray(y, float))), np.arange(n)
    sums, weights = np.zeros((2, n)), np.zeros(n)
    for offset in range(-window, window):
        near = at + offset
        w = np.where((near >= 0) & (near < n - 1), np.exp(-0.5 * (offset / window) ** 2), 0.0)
        sums += w * points[:, np.clip(near, 0, n - 1)]
        weights += w
    smooth = sums / weights
    spread = np.ptp(smooth, axis=1, keepdims=True)
    scaled = (smooth - smooth.min(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1)
    gap = scaled[1] - scaled[0]
    tops = [i for i in range(1, n - 1) if gap[i - 1] < gap[i] > gap[i + 1]]
    limit = sensitivity * (scaled[0, -1] - points[0, 0]) / (n - 1)
    return [i for i, end in zip(tops, [*tops[1:], n], strict=False) if gap[i:end].min() < gap[i] - limit]
