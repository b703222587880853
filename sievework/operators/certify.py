"""Risk-controlled search of the three-threshold rule (lambda_lo, lambda_hi, tau).

All risks of all grid points come from one aggregate: a row matters only by how many breakpoints are
at most its s, how many levels are at most its u, and its labels. So rows shrink to a histogram with
at most (K + 3) (K_tau + 1) cells a group, and the grid is joined with that, never with the rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import betting_lower_bound, hb_pvalues, n_min
from ..session import landed
from .splits import quantiles

#: The twelve anchors (lambda_lo, lambda_hi, tau) of the bound on the ensemble's error.
ANCHORS = [
    (0.1, 0.7, 0.2), (0.1, 0.7, 0.4), (0.1, 0.7, 0.6), (0.1, 0.9, 0.2), (0.1, 0.9, 0.4), (0.1, 0.9, 0.6),
    (0.2, 0.8, 0.2), (0.2, 0.8, 0.4), (0.2, 0.8, 0.6), (0.3, 0.9, 0.2), (0.3, 0.9, 0.4), (0.3, 0.9, 0.6),
]


def breakpoints(scored: DataFrame, k: int, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, points: k even quantiles of s with 0 and 1, sorted and distinct."""
    q = quantiles(scored, "s", [i / (k - 1) for i in range(k)], keys)
    return q.select(*keys, F.array_sort(F.array_distinct(F.concat("q", F.array(F.lit(0.0), F.lit(1.0))))).alias("points"))


def theta_grid(points: DataFrame, k_tau: int, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """All lambda_lo <= lambda_hi of the breakpoints with k_tau even taus, numbered in (lo, hi, tau) order.

    A key's grid comes of its own array of at most k + 2 points, so nothing is joined.
    """
    lo = points.select(*keys, "points", F.posexplode("points").alias("i_lo", "lambda_lo"))
    hi = lo.select(*keys, "points", "i_lo", "lambda_lo", F.posexplode("points").alias("i_hi", "lambda_hi")).where("i_hi >= i_lo")
    taus = F.array(*[F.lit(i / (k_tau - 1)) for i in range(k_tau)])
    grid = hi.select(*keys, "i_lo", "lambda_lo", "i_hi", "lambda_hi", F.posexplode(taus).alias("i_tau", "tau"))
    w = Window.partitionBy(*keys).orderBy("i_lo", "i_hi", "i_tau")
    return grid.withColumn("theta_idx", F.row_number().over(w) - 1)


def histogram(scored: DataFrame, points: DataFrame, k_tau: int, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, y, y_hat, bin_s, bin_u, n: the cells that all grid risks depend on."""
    taus = F.array(*[F.lit(i / (k_tau - 1)) for i in range(k_tau)])
    rows = scored.join(points, keys)
    bin_s = F.size(F.filter("points", lambda p: p <= F.col("s")))
    bin_u = F.size(F.filter(taus, lambda t: t <= F.col("u")))
    return rows.select(*keys, "y", "y_hat", bin_s.alias("bin_s"), bin_u.alias("bin_u")).groupBy(*keys, "y", "y_hat", "bin_s", "bin_u").agg(F.count("*").alias("n"))


def prefix_counts(cells: DataFrame, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, top_s, top_u, sums: for each i and t, flat at i * (top_u + 1) + t, the rows with bin_s <= i and bin_u >= t.

    ``sums`` has three counts an element: of all rows, of positives, of positives voted in. A key's table has as many
    elements as breakpoints times levels, whatever its rows; all steps follow the one shuffle that packs its cells.
    """
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("y", "y_hat", "bin_s", "bin_u", "n")).alias("cells"), F.max("bin_s").alias("top_s"), F.max("bin_u").alias("top_u"))
    # empty cells at the highest level, so that no place of the table is missing
    empty = F.transform(F.sequence(F.lit(0), F.col("top_s")), lambda i: F.struct(F.lit(0).alias("y"), F.lit(0).alias("y_hat"), i.alias("bin_s"), F.col("top_u").alias("bin_u"), F.lit(0).cast("long").alias("n")))
    rows = packed.select(*keys, "top_s", "top_u", F.explode("cells").alias("c")).unionByName(packed.select(*keys, "top_s", "top_u", F.explode(empty).alias("c")))
    levels = rows.select(*keys, "top_s", "top_u", "c.*", F.explode(F.sequence(F.lit(0), F.col("c.bin_u"))).alias("t"))
    own = {"n_all": F.col("n"), "n_pos": F.when(F.col("y") == 1, F.col("n")).otherwise(0), "n_voted": F.when((F.col("y") == 1) & (F.col("y_hat") == 1), F.col("n")).otherwise(0)}
    at = levels.groupBy(*keys, "top_s", "top_u", "bin_s", "t").agg(*[F.sum(c).alias(name) for name, c in own.items()])
    up_to = Window.partitionBy(*keys, "t").orderBy("bin_s").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumns({name: F.sum(name).over(up_to) for name in own}).groupBy(*keys, "top_s", "top_u").agg(F.array_sort(F.collect_list(F.struct("bin_s", "t", *own))).alias("sums"))


def grid_risks(grid: DataFrame, cells: DataFrame, c_human: float = 5.0, c_llm: float = 0.001, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """grid with m_plus, n_miss (positives below lambda_lo, or in the band with u >= tau), n_slack, n_all and cost.

    Each count is a difference of entries of prefix_counts(), so a grid point costs a few lookups, not a pass over the cells.
    """
    rows = grid.join(prefix_counts(cells, keys), keys)

    def upto(what: str, i: Column, t: Column) -> Column:
        inside = F.get("sums", F.least(i, F.col("top_s")) * (F.col("top_u") + 1) + t)[what]
        return F.when(t <= F.col("top_u"), inside).otherwise(F.lit(0).cast("long"))

    low, high, any_u, sure, end = F.col("i_lo"), F.col("i_hi"), F.lit(0), F.col("i_tau") + 1, F.col("top_s")

    def band(what: str, t: Column) -> Column:
        return upto(what, high, t) - upto(what, low, t)

    n_all, n_band = upto("n_all", end, any_u), band("n_all", any_u)
    counts = {"m_plus": upto("n_pos", end, any_u), "n_miss": upto("n_pos", low, any_u) + band("n_pos", sure), "n_slack": band("n_voted", sure), "n_all": n_all,
              "n_accept": n_all - upto("n_all", high, any_u), "n_band": n_band, "n_human": n_band - band("n_all", sure)}
    out = rows.select(*grid.columns, *[c.alias(name) for name, c in counts.items()])
    cost = (F.lit(c_human) * F.col("n_accept") + F.lit(c_llm) * F.col("n_band") + F.lit(c_human) * F.col("n_human")) / F.col("n_all")
    return out.withColumn("cost", cost)


def pvalues(risks: DataFrame, alpha: Column) -> DataFrame:
    """r_hat and the p-value of each grid point against the inflated risk ``alpha``.

    A p-value depends on the misses, the positives and the risk only: each distinct triple is computed once,
    all misses of one risk and number of positives in one pass over the binomial's terms. The grid's risks are landed:
    their plan is long, and both the triples and the rows they are joined to come of it.
    """
    rows = landed(risks.withColumns({"r_hat": F.col("n_miss") / F.col("m_plus"), "__alpha": alpha.cast("double")}), "grid-risks")
    triples = rows.where("m_plus > 0 and __alpha > 0 and __alpha < 1").select("n_miss", "m_plus", F.col("__alpha").alias("a")).distinct()

    def test(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(p=hb_pvalues(part["n_miss"].to_numpy(), int(key[0]), float(key[1])))[["n_miss", "m_plus", "a", "p"]]

    # a group has at most as many rows as a grid
    tested = triples.groupBy("m_plus", "a").applyInPandas(test, "n_miss long, m_plus long, a double, p double").withColumnsRenamed({"n_miss": "__n", "m_plus": "__m"})
    on = (F.col("n_miss") == F.col("__n")) & (F.col("m_plus") == F.col("__m")) & (F.col("__alpha") == F.col("a"))
    out = rows.join(tested, on, "left")
    return out.withColumn("p", F.when(F.col("__alpha") >= 1, 0.0).otherwise(F.col("p"))).drop("__n", "__m", "a", "__alpha")


def holm(rows: DataFrame, delta: float, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """certified by step-down: reject by rising p while p <= delta / (M - i)."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("p", "theta_idx")
    rows = rows.withColumn("__i", F.row_number().over(order) - 1).withColumn("__fail", (F.col("p") > F.lit(delta) / (F.count("*").over(w) - F.col("__i"))).cast("int"))
    return rows.withColumn("certified", F.max("__fail").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("__i", "__fail")


WALKS = {
    "safest": [("lambda_lo", 1), ("lambda_hi", 1), ("tau", -1)],
    "riskiest": [("lambda_lo", -1), ("lambda_hi", -1), ("tau", 1)],
    "tau_first": [("tau", 1), ("lambda_hi", 1), ("lambda_lo", 1)],
}


def walk(rows: DataFrame, delta: float, order: str = "safest", seed=0, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """certified by a fixed sequence: reject while p <= delta, stop at the first failure. ``order``: a name of WALKS, or "random"."""
    cols = [F.md5(F.concat_ws(":", F.lit(seed), "theta_idx").cast("binary"))] if order == "random" else [F.col(c).asc() if s > 0 else F.col(c).desc() for c, s in WALKS[order]]
    w = Window.partitionBy(*keys).orderBy(*cols, "theta_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("certified", F.max((F.col("p") > delta).cast("int")).over(w) == 0)


def cheapest(rows: DataFrame, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, n_certified, theta_idx, lambda_lo, lambda_hi, tau: the certified point of least cost; without any, the first point."""
    pick = F.struct(F.when(F.col("certified"), F.col("cost")).otherwise(F.lit(float("inf"))), "theta_idx")
    got = rows.groupBy(*keys).agg(F.count_if("certified").alias("n_certified"), F.min_by(F.struct("theta_idx", "lambda_lo", "lambda_hi", "tau"), pick).alias("t"))
    return got.select(*keys, "n_certified", "t.*")


def slack_samples(scored: DataFrame) -> DataFrame:
    """topic_id, anchor, pmid, slack: in the band, sure, and voted in, for each positive and anchor."""
    anchors = F.array(*[F.struct(F.lit(i).alias("anchor"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(t).alias("tau")) for i, (lo, hi, t) in enumerate(ANCHORS)])
    rows = scored.where("y = 1").select("topic_id", "pmid", "s", "u", "y_hat", F.explode(anchors).alias("a"))
    hit = (F.col("s") >= F.col("a.lo")) & (F.col("s") < F.col("a.hi")) & (F.col("u") >= F.col("a.tau")) & (F.col("y_hat") == 1)
    return rows.select("topic_id", F.col("a.anchor").alias("anchor"), "pmid", hit.cast("double").alias("slack"))


def anchor_bounds(scored: DataFrame, delta_eta: float) -> DataFrame:
    """topic_id, anchor, bound: betting lower bound of each anchor's slack at delta_eta / 12, samples in order of pmid.

    A group is one anchor of one topic's positives, the reference set of a calibration: their order matters, so they
    stay together, as one byte each.
    """
    level = delta_eta / len(ANCHORS)

    def bound(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, betting_lower_bound(rows.sort_values("pmid")["slack"].to_numpy(float), level))], columns=["topic_id", "anchor", "bound"])

    samples = slack_samples(scored).withColumn("slack", F.col("slack").cast("byte"))
    return samples.groupBy("topic_id", "anchor").applyInPandas(bound, "topic_id string, anchor int, bound double")


def certify(scored: DataFrame, alpha: float = 0.10, delta_eta: float = 0.03, delta_ltt: float = 0.07, k: int = 10, k_tau: int = 5, order: str | None = None, eta: DataFrame | None = None) -> DataFrame:
    """Certified thresholds of each topic from its calibration rows (topic_id, pmid, s, u, y, y_hat).

    Columns: topic_id, status, m_plus, eta, n_certified, theta_idx, lambda_lo, lambda_hi, tau. Topics with
    too few positives abstain. ``eta`` (topic_id, eta) replaces the betting bound.
    """
    gate = scored.groupBy("topic_id").agg(F.sum("y").cast("long").alias("m_plus"))
    bound = eta if eta is not None else anchor_bounds(scored, delta_eta).groupBy("topic_id").agg(F.min("bound").alias("eta"))
    gate = gate.join(bound, "topic_id", "left").withColumn("eta", F.coalesce("eta", F.lit(0.0))).withColumn("enough", F.col("m_plus") >= n_min(alpha, delta_ltt))
    use = scored.join(gate.where("enough").select("topic_id"), "topic_id", "left_semi")
    points = breakpoints(use, k)
    risks = grid_risks(theta_grid(points, k_tau), histogram(use, points, k_tau)).join(gate.select("topic_id", "eta"), "topic_id")
    tested = pvalues(risks, F.lit(alpha) + F.col("eta"))
    best = cheapest(holm(tested, delta_ltt) if order is None else walk(tested, delta_ltt, order))
    return gate.join(best, "topic_id", "left").select("topic_id", F.when(F.col("enough"), "certified").otherwise("abstained").alias("status"), "m_plus", "eta", "n_certified", "theta_idx", "lambda_lo", "lambda_hi", "tau")


def bootstrap_upper(n_slack: int, m: int, delta: float) -> float:
    """Upper quantile of the mean of m draws with replacement from 0/1 slack: a binomial quantile."""
    import math

    if m == 0 or n_slack in (0, m):
        return n_slack / m if m else 0.0
    q, total = n_slack / m, 0.0
    for i in range(m + 1):
        total += math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(q) + (m - i) * math.log1p(-q))
        if total >= 1 - delta:
            return i / m
    return 1.0
