"""Confusion metrics, and measures of ranked lists: one pass of cumulative sums per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wilson


def confusion(decisions: DataFrame, qrels: DataFrame, key: str = "pmid") -> DataFrame:
    """One row: EXCLUDE against the rest on judged documents; WSS and coverage over all decisions.

    wss has a sentinel of -0.05 without decisions; the interval of recall is Wilson's.
    """
    rows = decisions.join(qrels, key, "left").withColumn("p", (F.col("decision") != "EXCLUDE").cast("int"))
    c = rows.agg(F.count("*").alias("n_total"), F.count("rel").alias("n_judged"), *[F.count_if((F.col("rel") == r) & (F.col("p") == p)).alias(n) for n, r, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"recall": recall, "fnr": 1 - recall, "wss": F.when(F.col("n_total") > 0, (F.col("tn") + F.col("fn")) / F.col("n_total") - 0.05).otherwise(-0.05), "coverage": F.col("n_judged") / F.nullif(F.col("n_total"), F.lit(0)), "recall_low": low, "recall_high": high})


def accuracy(c: DataFrame) -> DataFrame:
    """precision, recall, f1, f2 of counts tp, fp, fn, rounded half to even at four places."""
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    rounded = {"precision": p, "recall": r, "f1": 2 * p * r / F.nullif(p + r, F.lit(0.0)), "f2": 5 * p * r / F.nullif(4 * p + r, F.lit(0.0))}
    return c.select(*[F.bround(v, 4).alias(k) for k, v in rounded.items()])


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """topic_id, pmid, rank, rel, seen, n_docs, n_rel: first place of each document, unknown ones 0, grades of 3 and more out."""
    first = run.groupBy("topic_id", "pmid").agg(F.min("rank").alias("at"))
    rows = first.join(qrels, ["topic_id", "pmid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).where("rel < 3").withColumn("rel", F.least("rel", F.lit(1)))
    w = Window.partitionBy("topic_id")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy("at", "pmid")).cast("long"))
    return rows.withColumns({"seen": F.sum("rel").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)), "n_docs": F.count("*").over(w), "n_rel": F.sum("rel").over(w)}).drop("at")


def measures(rows: DataFrame) -> DataFrame:
    """Count, precision, gain, area, and loss measures of each topic of a judged run."""
    n, r = F.first("n_docs"), F.first("n_rel")
    goal = F.bround(F.col("n_rel") * 0.95)
    area = F.sum(F.col("seen") - F.col("rel") / 2)
    most = r * n - r * r / 2
    out = rows.groupBy("topic_id").agg(
        n.alias("n_docs"), r.alias("n_rel"), (F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))) / F.nullif(r, F.lit(0))).alias("ap"),
        F.max(F.when(F.col("rel") == 1, F.col("rank"))).alias("last_rel"), F.min(F.when((F.col("seen") >= goal) & (F.col("n_rel") > 0), F.col("rank"))).alias("at_95"), F.bround(area / F.nullif(most, F.lit(0)), 3).alias("area"))
    return out.withColumns({"wss_100": F.when(F.col("last_rel").isNotNull(), (F.col("n_docs") - F.col("last_rel")) / F.col("n_docs")).otherwise(0.0), "wss_95": F.when(F.col("at_95").isNotNull(), (F.col("n_docs") - F.col("at_95")) / F.col("n_docs") - 0.05).otherwise(0.0)})


def decile_gain(rows: DataFrame) -> DataFrame:
    """topic_id, decile, gain: share of relevant documents within each tenth of the ranking (tenths of int(N/10))."""
    step = F.floor(F.col("n_docs") / 10)
    hit = rows.where((step > 0) & (F.col("rank") % step == 0) & (F.col("rank") / step <= 10) & (F.col("n_rel") > 0))
    return hit.select("topic_id", (F.col("rank") / step).cast("int").alias("decile"), (F.col("seen") / F.col("n_rel")).alias("gain"))


def losses(rows: DataFrame, shown: Column, b: int = 100) -> DataFrame:
    """topic_id, r, loss_r, loss_e, loss_er of the documents shown before a stop."""
    out = rows.groupBy("topic_id").agg(F.first("n_docs").alias("n"), F.first("n_rel").alias("rels"), F.count_if(shown).alias("shown"), F.count_if(shown & (F.col("rel") == 1)).alias("found")).where("rels > 0")
    r = F.col("found") / F.col("rels")
    e = F.pow(F.lit(b) / F.col("n"), 2) * F.pow(F.col("shown") / (F.col("rels") + b), 2)
    return out.select("topic_id", r.alias("r"), F.pow(1 - r, 2).alias("loss_r"), e.alias("loss_e"), (F.pow(1 - r, 2) + e).alias("loss_er"))


def costs(rows: DataFrame, action: str = "action") -> DataFrame:
    """topic_id, cost, penalty_uniform, penalty_weighted: nothing for skipped, 1 for shown, 3 for assessed documents; missed ones cost."""
    c = F.when(F.col(action) == "NS", 0).when(F.col(action) == "AF", 3).otherwise(1)
    missed = (F.col(action) == "NS") & (F.col("rel") == 1)
    w = Window.partitionBy("topic_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__k", F.sum(missed.cast("int")).over(w))
    out = rows.groupBy("topic_id").agg(F.sum(c).alias("cost"), F.count_if(missed).alias("missed"), F.first("n_docs").alias("n"), F.first("n_rel").alias("r"), F.sum(F.when(missed, F.pow(F.lit(2.0), -F.col("__k")))).alias("__w"))
    return out.select("topic_id", "cost", (F.col("missed") / F.nullif("r", F.lit(0)) * F.col("n")).alias("penalty_uniform"), (F.coalesce("__w", F.lit(0.0)) * F.col("n")).alias("penalty_weighted"))


def overall(per_topic: DataFrame, columns: list[str]) -> DataFrame:
    """Topics' rows and their average as topic ALL."""
    everything = per_topic.agg(*[F.avg(c).alias(c) for c in columns]).withColumn("topic_id", F.lit("ALL"))
    return per_topic.select("topic_id", *[F.col(c).cast("double").alias(c) for c in columns]).unionByName(everything)


def rank_windows(rows: DataFrame, windows: int = 100) -> DataFrame:
    """topic_id, window, n, n_rel, rate: features of a stopping policy; windows of N // 100 documents, the tail left out."""
    size = F.greatest(F.floor(F.col("n_docs") / windows), F.lit(1))
    w = F.floor((F.col("rank") - 1) / size).cast("int")
    return rows.withColumn("window", w).where(F.col("window") < windows).groupBy("topic_id", "window").agg(F.count("*").alias("n"), F.sum("rel").alias("n_rel"), F.avg(F.col("rel").cast("double")).alias("rate"))


def target_window(features: DataFrame, totals: DataFrame, target: float) -> DataFrame:
    """topic_id, window: the first one where cumulative recall reaches the target; totals: topic_id, total."""
    run = F.sum("n_rel").over(Window.partitionBy("topic_id").orderBy("window").rowsBetween(Window.unboundedPreceding, 0))
    return features.withColumn("c", run).join(totals, "topic_id").where((F.col("total") > 0) & (F.col("c") >= target * F.col("total"))).groupBy("topic_id").agg(F.min("window").alias("window"))
