"""Active-learning baselines: one loop, and stopping by recall, knee, estimate, buckets or a target set.

Documents are (pmid, features, rel). Each round fits a logistic ranker on what is assessed and on some random
other documents taken as irrelevant, ranks the rest and assesses more of it; batches grow, so rounds stay
logarithmic. Documents never leave the cluster: the driver sees counts of a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import knee
from ..session import landed
from .baselines import ap_prior, history_variance
from .splits import bucketed_rank

#: Random documents that a fit takes as irrelevant.
PRESUMED = 100
#: Examples of a fit that one task goes through.
EXAMPLES = 4096
LOG = "round int, assessed long, found long, estimate double"


def _order(seed):
    return F.xxhash64("pmid", F.lit(seed))


class SparseLinear:
    """A linear model of sparse vectors, by the weights of the features that its examples have; those of all others are 0."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds margin."""
        intercept, shared = self.intercept, rows.sparkSession.sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def margin(indices: pd.Series, values: pd.Series) -> pd.Series:
            row = np.repeat(np.arange(len(indices)), indices.map(len))
            if not len(row):
                return pd.Series(np.full(len(indices), intercept))
            at, x = np.concatenate(indices.to_list()).astype(np.int64), np.concatenate(values.to_list())
            return pd.Series(np.bincount(row, shared.value[at] * x, len(indices)) + intercept)

        v = F.unwrap_udt("features")
        return rows.withColumn("margin", margin(v["indices"], v["values"]))


def _fit_linear(estimator: Callable[[int], object], train: DataFrame):
    """Fits ``estimator(n)``; of sparse vectors over the features that occur in the examples, as all others get no weight.

    Each step of a fit sends a vector as long as the features to the driver for each of a few partitions; examples are
    few beside the vocabulary, and partitions follow the examples' number, not the number of files that they come from.
    """
    from pyspark.ml.linalg import Vectors, VectorUDT

    v = F.unwrap_udt("features")
    n, dense = train.agg(F.count("*"), F.count_if(v["type"] == 1)).first()
    active = np.array([] if dense else [r[0] for r in train.select(F.explode(v["indices"]).alias("i")).distinct().orderBy("i").collect()], np.int64)
    if not len(active):
        return estimator(n).fit(train.coalesce(1 + n // EXAMPLES))
    shared = train.sparkSession.sparkContext.broadcast(active)

    @F.udf(VectorUDT())
    def narrow(x):
        return Vectors.sparse(len(shared.value), np.searchsorted(shared.value, x.indices), x.values)

    model = estimator(n).fit(landed(train.select(narrow("features").alias("features"), "label").coalesce(1 + n // EXAMPLES), "learning-narrow"))
    weights = np.zeros(train.select(v["size"].alias("n")).first()[0])
    weights[active] = model.coefficients.toArray()
    return SparseLinear(weights, float(model.intercept))


def logistic(c: float = 1.0) -> Callable[[DataFrame], object]:
    """Fits a logistic ranker; ``c`` weighs the examples against the weights' size."""
    from pyspark.ml.classification import LogisticRegression

    return lambda train: _fit_linear(lambda n: LogisticRegression(regParam=1 / (c * max(1, n)), maxIter=50, aggregationDepth=4), train)


def linear_svm(c: float = 1.0) -> Callable[[DataFrame], object]:
    """Fits a linear support vector machine."""
    from pyspark.ml.classification import LinearSVC

    return lambda train: _fit_linear(lambda n: LinearSVC(regParam=1 / (c * max(1, n)), maxIter=30, aggregationDepth=4), train)


def boosted_trees(trees: int = 10, depth: int = 3, features: int = 50, presence: bool = True) -> Callable[[DataFrame], object]:
    """Fits boosted trees on the ``features`` whose means over the relevant and the other examples differ most.

    With ``presence``, trees ask whether a term occurs: a threshold on its weight, learned from the topic's short text,
    would lie above that of any long document.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Binarizer, VectorSlicer
    from pyspark.ml.stat import Summarizer

    def fit(train: DataFrame):
        means = {r["label"]: r["m"].toArray() for r in train.groupBy("label").agg(Summarizer.mean(F.col("features")).alias("m")).collect()}
        apart = np.abs(means[1.0] - means[0.0])
        best = VectorSlicer(inputCol="features", outputCol="chosen", indices=np.sort(np.argsort(-apart, kind="stable")[:features]).tolist())
        stages = [best, Binarizer(threshold=0.0, inputCol="chosen", outputCol="asked")] if presence else [best]
        ready = PipelineModel(stages=stages).transform(train)
        return PipelineModel(stages=[*stages, GBTClassifier(featuresCol="asked" if presence else "chosen", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)])

    return fit


def kept_terms(rows: DataFrame) -> DataFrame:
    """(.., text) to (.., kept): runs of two word characters and more in lower case, without English stop words."""
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    split = RegexTokenizer(inputCol="text", outputCol="terms", pattern=r"\w\w+", gaps=False)
    return StopWordsRemover(inputCol="terms", outputCol="kept").transform(split.transform(rows.withColumn("text", F.coalesce("text", F.lit(""))))).drop("text", "terms")


def tfidf(texts: DataFrame, fit_on: DataFrame | None = None, least: int = 2, most: int = 1 << 18):
    """A function from (.., text) to (.., features): unit vectors of term counts times log((1 + n) / (1 + df)) + 1.

    Terms are those of ``kept_terms``, in ``least`` texts of ``fit_on`` (default: ``texts``) and more; the ``most``
    frequent ones make up the vocabulary. Rows may have their terms as kept in place of text: texts are cut into terms
    once, not for each pass over them.
    """
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer

    corpus = texts if fit_on is None else fit_on
    corpus = corpus.select("kept") if "kept" in corpus.columns else landed(kept_terms(corpus.select("text")), "tfidf-terms")
    model = CountVectorizer(inputCol="kept", outputCol="counts", minDF=float(least), vocabSize=most).fit(corpus)
    idf = IDF(inputCol="counts", outputCol="idf").fit(model.transform(corpus)).idf.toArray() + 1.0
    weigh = ElementwiseProduct(inputCol="counts", outputCol="weighed", scalingVec=idf.tolist())

    def transform(rows: DataFrame) -> DataFrame:
        out = model.transform(rows if "kept" in rows.columns else kept_terms(rows))
        return Normalizer(inputCol="weighed", outputCol="features").transform(weigh.transform(out)).select(*[c for c in rows.columns if c not in ("text", "kept")], "features")

    return transform


def fitted(labelled: DataFrame, presumed: DataFrame, topic: DataFrame | None, ranker):
    """The model of a round: from the assessed documents, those presumed irrelevant, and the topic's own text as a relevant one.

    None while nothing relevant is known.
    """
    train = labelled.select("features", F.col("rel").cast("double").alias("label")).unionByName(presumed.select("features", F.lit(0.0).alias("label")))
    if topic is not None:
        train = train.unionByName(topic.select("features", F.lit(1.0).alias("label")))
    train = landed(train, "learning-train")
    relevant, other = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    return ranker(train) if relevant and other else None


def _scored(rest: DataFrame, model, seed) -> DataFrame:
    """pmid, rel, p; by chance while there is no model."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return rest.select("pmid", "rel", (F.pmod(_order(seed), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("p"))
    out = model.transform(rest)
    if "probability" in out.columns:
        return out.select("pmid", "rel", vector_to_array("probability")[1].alias("p"))
    margin = F.col("margin") if "margin" in out.columns else vector_to_array("rawPrediction")[1]  # of a support vector machine, in the same order
    return out.select("pmid", "rel", (1 / (1 + F.exp(-margin))).alias("p"))


def _best(scored: DataFrame, size: int) -> DataFrame:
    return scored.orderBy(F.col("p").desc(), "pmid").limit(size)


def loop(docs: DataFrame, batch: int, growth: float, seed, choose: Callable, done: Callable, topic: DataFrame | None = None, ranker=None) -> DataFrame:
    """round, assessed, found, estimate of each round.

    ``choose(scored, size, round)`` gives (pmid, assessed) rows of the rest: those that leave it, and whether they
    are assessed. ``done(log)`` gives the estimate of all relevant documents, or None, and whether to stop; the
    loop ends at the latest when no document is left. ``topic`` has the features of the topic's own text, a
    relevant example from the start; without it the first batch is random. ``ranker`` fits the model of a
    round (default: logistic).
    """
    spark, docs = docs.sparkSession, landed(docs.select("pmid", "features", "rel"), "learning-docs")
    ranker = ranker or logistic()
    if topic is None:
        seen = docs.orderBy(_order(seed)).limit(batch).select("pmid", F.lit(True).alias("assessed"))
    else:
        model = fitted(docs.limit(0), docs.orderBy(_order(f"{seed}:0")).limit(PRESUMED), topic, ranker)
        seen = choose(_scored(docs, model, seed), batch, 0)
    seen = landed(seen, "learning-seen")
    log, size = [], batch
    while True:
        labelled = landed(docs.join(seen.where("assessed").select("pmid"), "pmid"), "learning-labelled")
        n, found = labelled.agg(F.count("*"), F.coalesce(F.sum("rel"), F.lit(0))).first()
        log.append((len(log), n, int(found)))
        estimate, stop = done(log)
        log[-1] = (*log[-1], None if estimate is None else float(estimate))
        rest = docs.join(seen.select("pmid"), "pmid", "left_anti")
        if stop or rest.isEmpty():
            return spark.createDataFrame(log, LOG)
        size += math.ceil(size * growth)
        model = fitted(labelled, rest.orderBy(_order(f"{seed}:{len(log)}")).limit(PRESUMED), topic, ranker)
        seen = landed(seen.unionByName(choose(_scored(rest, model, seed), size, len(log))), "learning-seen")


def _assess_best(scored: DataFrame, size: int, number: int) -> DataFrame:
    return _best(scored, size).select("pmid", F.lit(True).alias("assessed"))


def autotar(docs: DataFrame, stop_recall: float | None = None, stop_share: float = 1.0, batch: int = 1, growth: float = 0.1, seed=1, **settings) -> DataFrame:
    """Stops when the recall is reached, or the share of all documents is assessed."""
    total, n_docs = docs.where("rel = 1").count(), docs.count()

    def done(log):
        _, n, found = log[-1]
        return None, n >= int(stop_share * n_docs) or bool(stop_recall is not None and total and found >= stop_recall * total)

    return loop(docs, batch, growth, seed, _assess_best, done, **settings)


def knee_slopes(log: list[tuple]) -> float | None:
    """Gain per document up to the last knee of (assessed, found), over that after it; None without a knee."""
    at = knee([r[1] for r in log], [r[2] for r in log])
    if not at:
        return None
    (_, n1, r1), (_, n2, r2) = log[at[-1]][:3], log[-1][:3]
    return (r1 / n1) / ((r2 - r1 + 1) / (n2 - n1)) if n1 and n2 > n1 else 0.0


def knee_stop(docs: DataFrame, least: int = 100, ratio: float | None = None, batch: int = 1, growth: float = 0.1, seed=1, **settings) -> DataFrame:
    """Stops behind a knee: when the slopes before and after it are ``ratio`` apart and over ``least`` documents are assessed.

    The default ratio is 156 less the documents found when the first knee shows, 6 at least; it then stays.
    """
    state = {"ratio": ratio}

    def done(log):
        slopes = knee_slopes(log)
        if slopes is not None and state["ratio"] is None:
            state["ratio"] = 156 - min(log[-1][2], 150)
        return None, slopes is not None and slopes > state["ratio"] and log[-1][1] > least

    return loop(docs, batch, growth, seed, _assess_best, done, **settings)


def target_stop(docs: DataFrame, targets: int = 10, batch: int = 100, growth: float = 0.1, seed=1) -> DataFrame:
    """Stops when a random set of relevant documents, drawn beforehand and never shown to the ranker, is found.

    The set is the first ``targets`` relevant documents in a random order of all; the documents drawn to find
    it count as looked at, but not as assessed.
    """
    hidden = landed(docs.where("rel = 1").orderBy(_order(f"target:{seed}")).limit(targets).select("pmid"), "learning-targets")
    state = {"found": hidden.sparkSession.createDataFrame([], hidden.schema)}

    def choose(scored, size, number):
        picked = landed(_assess_best(scored, size, number), "learning-picked")
        state["found"] = landed(state["found"].unionByName(picked.join(hidden, "pmid").select("pmid")), "learning-found")
        return picked

    first = docs.orderBy(_order(seed)).limit(batch).select("pmid")
    state["found"] = landed(first.join(hidden, "pmid").select("pmid"), "learning-found")
    return loop(docs, batch, growth, seed, choose, lambda log: (None, hidden.join(state["found"], "pmid", "left_anti").isEmpty()))


#: Ranks of a block in which draws find their documents.
BLOCK = 4096


def draw_ranks(ranks: DataFrame, size: int, seed: str) -> DataFrame:
    """pmid of the documents hit by ``size`` draws with replacement in proportion to w; ``ranks`` has pmid, rank (from 1), w.

    A draw is a hash of its number on a line that the weights fill in the order of ranks. It finds its block
    by the blocks' sums, and its document inside; blocks are bounded, so no task sees a whole ranking.
    """
    ranks = ranks.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK))
    sums = ranks.groupBy("block").agg(F.sum("w").alias("w")).orderBy("block").collect()  # one number a block
    ends, names = np.cumsum([r["w"] for r in sums]), np.array([r["block"] for r in sums], np.int64)
    starts, whole = np.r_[0.0, ends[:-1]], float(ends[-1])

    def to_blocks(batches):
        for batch in batches:
            at = batch["u"].to_numpy() * whole
            block = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
            yield pd.DataFrame({"block": names[block], "at": at - starts[block]})

    def inside(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("rank")
        at = np.minimum(np.searchsorted(np.cumsum(docs["w"].to_numpy()), hits["at"].to_numpy(), "right"), len(docs) - 1)
        return docs.iloc[np.unique(at)][["pmid"]] if len(docs) and len(hits) else docs.iloc[:0][["pmid"]]

    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    draws = ranks.sparkSession.range(size).select(u.alias("u")).mapInPandas(to_blocks, "block long, at double")
    return ranks.select("block", "pmid", "rank", "w").groupBy("block").cogroup(draws.groupBy("block")).applyInPandas(inside, f"pmid {dict(ranks.dtypes)['pmid']}")


def autostop(docs: DataFrame, recall: float = 1.0, weight=ap_prior, condition: str = "loose", batch: int = 1, growth: float = 0.1, seed=1, topic: DataFrame | None = None, ranker=None) -> DataFrame:
    """Stops when the found documents are ``recall`` of a Horvitz-Thompson estimate of all.

    In each round all documents, assessed or not, are ranked anew, and ``size`` are drawn with replacement in
    proportion to ``weight(rank, n, size)``; inclusion probabilities build up over the rounds. The conditions strict1 and
    strict2 add the estimate's standard deviation: with joint inclusion probabilities, or as of a simple
    sample. The log has the estimate and that deviation. Without a ``topic`` the first round draws evenly.
    """
    if condition not in ("loose", "strict1", "strict2"):
        raise ValueError(f"unknown condition: {condition}")
    ranker = ranker or logistic()
    docs = landed(docs.select("pmid", "features", "rel"), "autostop-docs")
    n_docs, spark = docs.count(), docs.sparkSession
    none = docs.select("pmid").limit(0)
    chance, seen, rounds = docs.select("pmid", F.lit(0.0).alias("log_out")), none, []
    log, size = [], batch
    while n_docs:
        labelled = docs.join(seen, "pmid")
        rest = docs.join(seen, "pmid", "left_anti")
        model = fitted(labelled, rest.orderBy(_order(f"{seed}:{len(log)}")).limit(PRESUMED), topic, ranker)
        scored = _scored(docs, model, seed)
        ranks = bucketed_rank(landed(scored.withColumn("all", F.lit(0)), "autostop-scored"), ["all"], [F.col("p").desc(), F.col("pmid")], F.floor((1 - F.col("p")) * 1000), "rank")
        ranks = landed(ranks.select("pmid", "rank", (weight(F.col("rank"), F.lit(n_docs), size) if model else F.lit(1.0)).cast("double").alias("w")), "autostop-ranks")
        whole = ranks.agg(F.sum("w")).first()[0]
        p = F.least(F.col("w") / whole, F.lit(1 - 1e-12))
        rounds.append((size, ranks.select("pmid", p.alias("p"))))
        seen = landed(seen.unionByName(draw_ranks(ranks, size, f"{seed}:draw:{len(log)}")).distinct(), "autostop-seen")
        chance = landed(chance.join(rounds[-1][1], "pmid").select("pmid", (F.col("log_out") + size * F.log(1 - F.col("p"))).alias("log_out")), "autostop-chance")
        known = seen.join(chance, "pmid").join(docs.select("pmid", "rel"), "pmid").withColumn("pi", 1 - F.exp("log_out"))
        v, found, total, squares = known.agg(F.count("*"), F.coalesce(F.sum("rel"), F.lit(0)), F.coalesce(F.sum(F.col("rel") / F.col("pi")), F.lit(0.0)), F.coalesce(F.sum(F.col("rel") / (F.col("pi") * F.col("pi"))), F.lit(0.0))).first()
        variance = 0.0
        if condition == "strict1" and rounds[1:]:
            relevant, history = known.where("rel = 1").select("pmid"), None
            for t, (_, own) in enumerate(rounds):
                part = own.join(relevant, "pmid").withColumn("t", F.lit(t))
                history = part if history is None else history.unionByName(part)
            history = history.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("h")).select("pmid", F.transform("h", lambda x: x["p"]).alias("p"))
            variance = history_variance(landed(history, "autostop-history"), [n for n, _ in rounds])
        elif condition == "strict2" and rounds[1:] and v > 1:
            variance = (n_docs - v) / n_docs / v / (v - 1) * (v * v * squares - v * total * total)
        log.append((len(log), v, int(found), float(total), math.sqrt(max(0.0, variance))))
        if v == n_docs or found and found >= recall * (total + log[-1][4]):
            break
        size += math.ceil(size * growth)
    return spark.createDataFrame(log, LOG + ", deviation double")


def autostop_collections(docs: DataFrame, part: str, at_once: int = 4, **settings) -> DataFrame:
    """autostop() of each part of a large collection, ``at_once`` side by side; a part is a column's value, and there are few.

    A round is many short jobs that leave cores idle, so another part's jobs fit between them.
    """
    run = inheritable_thread_target(docs.sparkSession)
    values = sorted(r[0] for r in docs.select(part).distinct().collect())
    if not values:
        return docs.sparkSession.createDataFrame([], LOG + ", deviation double").withColumn(part, F.lit(None).cast("int"))
    with ThreadPoolExecutor(at_once) as pool:
        # each task inherits the caller's job properties by a wrapper of its own
        logs = list(pool.map(lambda f: f(), [run(partial(autostop, docs.where(F.col(part) == value), **settings)) for value in values]))
    return reduce(DataFrame.unionByName, [log.withColumn(part, F.lit(value)) for value, log in zip(values, logs)])


def scal(docs: DataFrame, recall: float = 1.0, share: float = 0.8, most: int = 30, calibration: float = 1.05, batch: int = 1, growth: float = 0.5, seed=1) -> DataFrame:
    """Sub-sampled learning: of each bucket of best documents at most ``most`` are assessed and stand for all of it.

    It runs over a random ``share`` of the documents until that is used up. One more column, kept: whether the
    round comes before the estimate has reached ``recall`` of the final one, calibrated by ``calibration``.
    """
    pool = docs.where(F.pmod(_order(f"pool:{seed}"), F.lit(1 << 30)) < int(share * (1 << 30)))
    state = {"total": 0.0}

    def choose(scored, size, number):
        bucket = landed(_best(scored, size).withColumn("draw", _order(f"{seed}:{number}")), "scal-bucket")
        n = bucket.count()
        chosen = landed(bucket.orderBy("draw", "pmid").limit(max(1, min(most, n))).select("pmid", "rel"), "scal-chosen")
        state["total"] += float(chosen.agg(F.coalesce(F.sum("rel"), F.lit(0))).first()[0]) * n / max(1, min(most, n))
        return bucket.select("pmid").join(chosen.select("pmid", F.lit(True).alias("assessed")), "pmid", "left").select("pmid", F.coalesce("assessed", F.lit(False)).alias("assessed"))

    log = loop(pool, batch, growth, seed, choose, lambda log: (state["total"], False))
    goal = recall * calibration * state["total"]
    return log.withColumn("kept", F.col("estimate") < goal)
