"""Plain versions that tests hold the library against, written without it."""

import math


def plain_knees(points, window=1, sensitivity=10.0):
    """Indices of the knees of a curve, point by point."""
    n = len(points)
    if n < 3:
        return []
    smooth = []
    for i in range(n):
        used = [(math.exp(-((j - i) / window) ** 2 / 2), points[j]) for j in range(max(0, i - window), min(n - 1, i + window))]
        total = sum(w for w, _ in used)
        smooth.append((sum(w * p[0] for w, p in used) / total, sum(w * p[1] for w, p in used) / total))
    low, high = [min(c) for c in zip(*smooth)], [max(c) for c in zip(*smooth)]
    scaled = [[(p[k] - low[k]) / ((high[k] - low[k]) or 1) for k in (0, 1)] for p in smooth]
    gap = [y - x for x, y in scaled]
    step = sensitivity * (scaled[-1][0] - points[0][0]) / (n - 1)
    out, top, found = [], None, False
    for i in range(n):
        if 0 < i < n - 1 and gap[i - 1] < gap[i] and gap[i] > gap[i + 1]:
            top, found = i, False
        if top is not None and not found and gap[i] < gap[top] - step:
            out.append(top)
            found = True
    return out


def plain_joint_variances(p, y, sampled, draws):
    """Horvitz-Thompson total and both variances by sums over all pairs; ``p`` has a list for each document with one value a round."""
    n = len(p)
    pi = [1 - math.prod((1 - x) ** k for x, k in zip(row, draws)) for row in p]
    drawn = [i for i in range(n) if sampled[i]]
    total, v = sum(y[i] / pi[i] for i in drawn), len(drawn)
    one = sum((1 / pi[i] ** 2 - 1 / pi[i]) * y[i] ** 2 for i in drawn)
    for i in drawn:
        for j in drawn:
            if i != j and y[i] and y[j]:
                both = pi[i] + pi[j] - (1 - math.prod((1 - a - b) ** k for a, b, k in zip(p[i], p[j], draws)))
                one += 1 / (pi[i] * pi[j]) - 1 / both
    two = (n - v) / n / v / (v - 1) * sum((v * y[i] / pi[i] - total) ** 2 for i in drawn) if v > 1 else 0
    return total, one, two


def plain_run(rates, hits, sizes, policy, target, steps):
    """A stopping policy step by step: location, steps, stopped, last reward, sum of rewards, documents seen."""
    goal = next((i for i in range(steps) if sum(hits) and sum(hits[: i + 1]) / sum(hits) >= target), None)
    at, first, taken, rewards = 0, True, 0, []
    while True:
        stop = policy([r if i <= at else -1 for i, r in enumerate(rates)], at)
        over = stop or at >= steps - 1 or at >= steps - 2
        if not stop:
            at, first = (at, False) if first else (at + 1, False)
        taken += 1
        if goal is not None:
            a, t = at + 1, goal + 1
            rewards.append(1 - (a - 1) / t if a <= t else -(a - t) / (steps - t))
        if over:
            return at, taken, stop, rewards[-1] if rewards else None, sum(rewards) if rewards else None, sum(sizes[: at + 1])


def plain_betting_bound(x, delta, strategy="prpl", steps=200):
    """Largest mean that a bettor, sample by sample, rules out at one of the stops; every stop is searched for itself."""
    n, level, best = len(x), 2 * delta, 0.0
    stops = sorted({round(1 + (n - 1) * i / (min(steps, n) - 1)) if n > 1 else 1 for i in range(min(steps, n))})

    def wealth(m, stop):
        total, mean, var, ahead, square = 0.0, 0.5, 0.25, 0.0, 1.0
        for t, v in enumerate(x[:stop], 1):
            bet = min(1.0, math.sqrt(2 * math.log(2 / level) / (t * max(var, 1e-10)))) if strategy == "prpl" else min(0.5, max(0.0, ahead / square))
            total += math.log(max(1 + bet * (v - m), 1e-300))
            mean = (mean * (t - 1) + v) / t
            var = max((var * (t - 1) + (v - mean) ** 2) / t, 1 / (4 * (t + 1)))
            ahead, square = ahead + v - m, square + (v - m) ** 2
        return total

    for stop in stops:
        if wealth(best, stop) >= math.log(1 / level):
            low, high = best, 1.0
            for _ in range(45):
                mid = (low + high) / 2
                low, high = (mid, high) if wealth(mid, stop) >= math.log(1 / level) else (low, mid)
            best = low
    return best


def plain_quantile(values, q):
    """Linear interpolation between the neighbours of q * (n - 1)."""
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = q * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])
