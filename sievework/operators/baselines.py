"""Baselines: conformal thresholds, inclusion-probability estimators, score distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import inverse_normal
from ..session import landed
from .splits import borders, bucket_of, bucketed_rank, draw, quantiles, stratified_split


def crc_threshold(positives: DataFrame, alpha: Column | float, keys: list[str]) -> DataFrame:
    """keys, lambda_star: the k-th smallest positive score, k = floor(alpha (n + 1)) - 1 from 0; none: 0."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    rows = landed(positives, "crc-positives")
    # places by buckets: a key's positives grow with the corpus
    rows = bucketed_rank(rows, keys, [F.col("s")], bucket_of(F.col("s"), borders(rows, "s", 256)), "__i").withColumn("__i", F.col("__i") - 1)
    rows = rows.withColumn("__k", F.floor(a * (F.col("stratum_size") + 1) + 1e-12) - 1)
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__i") == F.col("__k"), F.col("s"))), F.lit(0.0)).alias("lambda_star"))


def scrc(scored: DataFrame, alpha: float, abstain: float = 0.1, inductive: bool = False, seed=7, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, tau, lambda_star of the calibration rows (s, u, y): tau from one half (or all), the threshold from the other half (or all)."""
    one = two = scored
    if inductive:
        split = landed(stratified_split(scored, [*keys, "y"], "pmid", seed, [0.5], "__half"), "scrc-halves")
        one, two = split.where("__half = 0"), split.where("__half = 1")
    tau = quantiles(one, "u", [abstain], keys).select(*keys, F.get("q", 0).alias("tau"))
    chosen = two.join(tau, keys).where((F.col("y") == 1) & (F.col("u") >= F.col("tau")))
    return tau.join(crc_threshold(chosen, alpha, keys), keys, "left").withColumn("lambda_star", F.coalesce("lambda_star", F.lit(0.0)))


def scrc_accept(rows: DataFrame, fitted: DataFrame, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    return rows.join(fitted, keys).withColumn("accepted", (F.col("u") >= F.col("tau")) & (F.col("s") >= F.col("lambda_star")))


def scrc_result(rows: DataFrame, method: str, target: float, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """The baselines' common columns: method, target, examined, recall, WSS at the target with its status."""
    recall = F.count_if((F.col("y") == 1) & F.col("accepted")) / F.nullif(F.count_if(F.col("y") == 1), F.lit(0))
    out = rows.groupBy(*keys).agg(F.count_if("accepted").alias("examined"), recall.alias("recall_achieved"), (F.count_if(~F.col("accepted")) / F.count("*") - F.lit(1 - target)).alias("w"))
    ok = F.col("recall_achieved") >= target
    return out.select(F.lit(method).alias("method"), *keys, F.lit(target).alias("target_recall"), "examined", "recall_achieved", F.when(ok, F.col("w")).alias("wss"), F.when(F.col("recall_achieved").isNull(), "no_positives").when(ok, "ok").otherwise("recall_missed").alias("wss_status"))


# Sampling distributions over a ranking of n_docs documents, from rank 1.
def uniform(rank: Column, n: Column, size: int = 0) -> Column:
    return 1 / n


def power_law(rank: Column, n: Column, size: int = 0, beta: float = -0.1) -> Column:
    return F.pow(rank.cast("double"), F.lit(beta))


def ap_prior(rank: Column, n: Column, size: int = 0) -> Column:
    return F.log((n + 1) / rank)


def mixture(rank: Column, n: Column, size: int = 0, head: int = 100, share: float = 0.9) -> Column:
    top = F.least(n, F.lit(head))
    return F.when(rank <= head, share / top).otherwise((1 - share) / F.greatest(n - top, F.lit(1)))


def batch_mixture(rank: Column, n: Column, size: int, epsilon: float = 0.5) -> Column:
    """Weights of a round of the mixture: the batch's best documents by 1 - epsilon / size each, the others share epsilon."""
    top = F.least(n, F.lit(size))
    return F.when(rank <= top, 1 - epsilon / top).otherwise(epsilon / F.greatest(n - top, F.lit(1)))


def probabilities(rows: DataFrame, weight, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """p: the weight of each rank, normalised over the topic."""
    weighed = rows.withColumn("__w", weight(F.col("rank"), F.col("n_docs")))
    sums = weighed.groupBy(*keys).agg(F.sum("__w").alias("__sum"))
    return weighed.join(sums, keys).withColumn("p", F.col("__w") / F.col("__sum")).drop("__w", "__sum")


def horvitz_thompson(rows: DataFrame, draws: int, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, total, variance: sum of y / pi with pi = 1 - (1 - p)^draws; the variance takes draws as independent."""
    pi = 1 - F.exp(F.lit(draws) * F.log(1 - F.col("p")))
    return rows.where("sampled").withColumn("__pi", pi).groupBy(*keys).agg(F.sum(F.col("rel") / F.col("__pi")).alias("total"), F.sum(F.col("rel") * (1 - F.col("__pi")) / (F.col("__pi") * F.col("__pi"))).alias("variance"))


def joint_variances(rows: DataFrame, draws: int, resolution: float | None = 1e-3, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, total, variance1, variance2 of the Horvitz-Thompson total after ``draws`` draws with replacement.

    variance1 takes in how likely two documents are drawn together, pi_i + pi_j - 1 + (1 - p_i - p_j)^draws (computed
    without cancellation, as pi_i pi_j less how much likelier than by chance neither is drawn), for all pairs
    of relevant sampled documents; variance2 is that of a simple random sample of the v documents drawn.
    Pairs are summed over cells of documents whose probabilities agree: exactly (``resolution`` None), or by
    the logarithm to within ``resolution``, with the cell's mean, which bounds the cells of a topic whatever its size.
    """
    p = F.col("p")

    def included(p: Column) -> Column:
        return -F.expm1(draws * F.log1p(-p))

    cell = p if resolution is None else F.floor(F.log(p) / resolution)
    whole = rows.withColumn("__pi", included(p)).groupBy(*keys).agg(
        F.count("*").alias("__n"), F.count_if("sampled").alias("__v"), F.sum(F.when(F.col("sampled"), F.col("rel") / F.col("__pi")).otherwise(0.0)).alias("total"),
        F.sum(F.when(F.col("sampled"), F.col("rel") / (F.col("__pi") * F.col("__pi"))).otherwise(0.0)).alias("__sq"))
    cells = rows.where(F.col("sampled") & (F.col("rel") == 1)).groupBy(*keys, cell.alias("__cell")).agg(F.avg(p).alias("__p"), F.count("*").alias("__m"))
    cells = cells.withColumn("__pi", included(F.col("__p")))
    others = cells.groupBy(*keys).agg(F.collect_list(F.struct("__cell", "__p", "__pi", "__m")).alias("__others"))

    def with_cell(total: Column, other: Column) -> Column:
        odds = F.col("__p") / (1 - F.col("__p")) * other["__p"] / (1 - other["__p"])
        both = F.col("__pi") * other["__pi"] + (1 - F.col("__pi")) * (1 - other["__pi"]) * F.expm1(draws * F.log1p(-odds))
        pairs = F.col("__m") * (other["__m"] - F.when(other["__cell"] == F.col("__cell"), 1).otherwise(0))
        return total + F.when((pairs > 0) & (both > 0), pairs * (1 / (F.col("__pi") * other["__pi"]) - 1 / both)).otherwise(0.0)

    own = F.col("__m") * (1 / (F.col("__pi") * F.col("__pi")) - 1 / F.col("__pi"))
    first = cells.join(others, keys).groupBy(*keys).agg(F.sum(own + F.aggregate("__others", F.lit(0.0), with_cell)).alias("__one"))
    v = F.col("__v")
    second = (F.col("__n") - v) / F.col("__n") / v / (v - 1) * (v * v * F.col("__sq") - 2 * v * F.col("total") * F.col("total") + v * F.col("total") * F.col("total"))
    return whole.join(first, keys, "left").select(*keys, "total", F.coalesce("__one", F.lit(0.0)).alias("variance1"), F.when(v > 1, second).otherwise(0.0).alias("variance2"))


def history_variance(history: DataFrame, draws: list[int], block: int = 512) -> float:
    """variance1 where probabilities changed from round to round: ``history`` has pmid and p of each round, in order, of the relevant sampled documents.

    Documents meet in blocks, each pair of blocks once; a block has ``block`` documents.
    """
    import numpy as np
    import pyarrow as pa

    n = history.count()
    if not n:
        return 0.0
    blocks = -(-n // block)
    packed = history.groupBy(F.pmod(F.xxhash64("pmid"), F.lit(blocks)).cast("int").alias("a")).agg(F.collect_list("p").alias("p"))
    pairs = packed.select("a", "p", F.explode(F.sequence("a", F.lit(blocks - 1))).alias("b")).join(packed.select(F.col("a").alias("b"), F.col("p").alias("q")), "b")
    times = np.array(draws, float)

    def sums(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x, y = np.array(row["p"]), np.array(row["q"])
                px, py = (-np.expm1(np.log1p(-m) @ times) for m in (x, y))
                x, y, log_tie = x / (1 - x), y / (1 - y), np.zeros((len(x), len(y)))
                for t, k in enumerate(times):
                    log_tie += k * np.log1p(-np.minimum(x[:, t, None] * y[None, :, t], 1 - 1e-15))
                each = px[:, None] * py[None, :]
                both = each + (1 - px)[:, None] * (1 - py)[None, :] * np.expm1(log_tie)
                part = np.where(both > 0, 1 / each - 1 / np.where(both > 0, both, 1), 0.0)
                if row["a"] == row["b"]:
                    np.fill_diagonal(part, 1 / px ** 2 - 1 / px)
                    out.append(part.sum())
                else:
                    out.append(2 * part.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["v"])

    return float(pairs.mapInArrow(sums, "v double").agg(F.sum("v")).first()[0])


def hansen_hurwitz(rows: DataFrame, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, total, variance: mean of y / p over the draws."""
    v = F.col("rel") / F.col("p")
    return rows.where("sampled").groupBy(*keys).agg(F.avg(v).alias("total"), (F.var_pop(v) / F.nullif(F.count("*") - 1, F.lit(0))).alias("variance"))


def sampled(rows: DataFrame, n: int, seed, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """sampled: the n documents of each topic that come first by seeded order divided by their probability."""
    u = (F.conv(F.substring(draw(seed, F.col("pmid")), 1, 13), 16, 10).cast("double") + 1) / 16.0 ** 13
    order = -F.log(u) / F.col("p")
    # exponential clocks: the n smallest are a draw without replacement in proportion to p
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.withColumn("sampled", F.col("__r") <= n).drop("__r")


def stratified_total(rows: DataFrame, bucket: int, n: int, seed, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, total: n documents sampled of every ``bucket`` ranks, each standing for its share of the bucket."""
    parts = rows.withColumn("__part", F.floor((F.col("rank") - 1) / bucket))
    r = bucketed_rank(parts.withColumn("__d", draw(seed, F.col("pmid"))), [*keys, "__part"], [F.col("__d"), F.col("pmid")], F.substring("__d", 1, 1), "__r")
    return r.where(F.col("__r") <= n).groupBy(*keys).agg(F.sum(F.col("rel") * F.col("stratum_size") / F.least("stratum_size", F.lit(n))).alias("total"))


def score_cutoff(scored: DataFrame, training: DataFrame, recall: float, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """keys, cutoff, n_kept: z-scores, a normal law fitted to the relevant training scores, and its quantile."""
    z = (F.col("score") - F.avg("score").over(Window.partitionBy(*keys))) / F.nullif(F.stddev_pop("score").over(Window.partitionBy(*keys)), F.lit(0.0))
    law = training.withColumn("z", z).where("rel = 1").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    cut = law.select(F.col("m") + F.lit(inverse_normal(1 - recall)) * F.col("s"))
    return scored.withColumn("z", z).withColumn("cutoff", cut.scalar()).groupBy(*keys).agg(F.first("cutoff").alias("cutoff"), F.count_if(F.col("z") >= F.col("cutoff")).alias("n_kept"))


def stopping_state(features: DataFrame, windows: int = 100) -> DataFrame:
    """topic_id, state: rates of the windows seen so far, -1 for unseen ones: a stopping policy's input."""
    rates = F.map_from_entries(F.collect_list(F.struct("window", "rate")))
    return features.groupBy("topic_id").agg(rates.alias("m")).select("topic_id", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1.0))).alias("state"))
