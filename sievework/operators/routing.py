"""Routing by certified thresholds, and its metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import n_min

ROUTES = ["auto_accept", "auto_reject", "llm_escalate", "human_review"]


def route(s: Column, u: Column, lo: Column, hi: Column, tau: Column) -> Column:
    """Acceptance wins over rejection where the thresholds cross."""
    return F.when(s >= hi, "auto_accept").when(s < lo, "auto_reject").when(u >= tau, "llm_escalate").otherwise("human_review")


def five_way(s: Column, u: Column, lo: Column, hi: Column, tau: Column, b: int = 5) -> Column:
    """Routing with the escalated side decided by the rounded number of Include votes."""
    return F.when(s < lo, "auto_reject").when(s >= hi, "auto_accept").when(u < tau, "human_review").when(F.bround(u * b) > b / 2, "llm_include").otherwise("llm_exclude")


def routed(scored: DataFrame, theta: DataFrame, keys: list[str] = ["topic_id"]) -> DataFrame:  # noqa: B006
    """Rows with their topic's thresholds and route; ``theta``: keys, lambda_lo, lambda_hi, tau."""
    rows = scored.join(theta.select(*keys, "lambda_lo", "lambda_hi", "tau"), keys)
    return rows.withColumn("route", route(F.col("s"), F.col("u"), F.col("lambda_lo"), F.col("lambda_hi"), F.col("tau")))


def routed_ids(ids: DataFrame, scores: DataFrame, lo: float, hi: float, tau: float) -> DataFrame:
    """Routes of ids; unknown ones have scores of 0. EXCLUDE only where they are rejected."""
    rows = ids.join(scores.select("pmid", "s", "u"), "pmid", "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "u": F.coalesce("u", F.lit(0.0))})
    r = route(F.col("s"), F.col("u"), F.lit(lo), F.lit(hi), F.lit(tau))
    return rows.withColumn("route", r).withColumn("decision", F.when(F.col("route") == "auto_reject", "EXCLUDE").otherwise("INCLUDE"))


def needs_human(abstract_source: Column) -> Column:
    """Documents without an abstract bypass the rule."""
    return F.coalesce(abstract_source, F.lit("original")) == "unavailable"


def missed(with_votes: bool = True) -> Column:
    """A positive that its route loses: rejected, or escalated and (without votes: always) voted out."""
    escalated = F.col("route") == "llm_escalate"
    return (F.col("route") == "auto_reject") | (escalated & (F.col("y_hat") == 0) if with_votes else escalated)


def included() -> Column:
    """Whether the whole procedure includes a document, the escalated ones by their votes."""
    return F.when(F.col("route") == "auto_reject", 0).when(F.col("route") == "llm_escalate", F.col("y_hat")).otherwise(1)


def _share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def evaluate(rows: DataFrame, keys: list[str] = ["topic_id"], target: float = 0.95, b: int = 5) -> DataFrame:  # noqa: B006
    """Route counts and shares, FNR (0 without positives) and WSS (null where recall misses the target)."""
    pos, inc = F.col("y") == 1, included()
    recall = F.count_if(pos & (inc == 1)) / F.when(F.count_if(pos) > 0, F.count_if(pos))
    wss = (F.count_if(inc == 0) / F.count("*")) - F.lit(1 - target)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), *[F.count_if(F.col("route") == r).alias(f"n_{r}") for r in ROUTES], *[_share(F.col("route") == r).alias(f"frac_{r}") for r in ROUTES],
        F.coalesce(F.count_if(pos & missed()) / F.when(F.count_if(pos) > 0, F.count_if(pos)), F.lit(0.0)).alias("fnr"), recall.alias("recall"), F.when(recall >= target, wss).alias("wss"),
        (F.lit(b) * _share(F.col("route") == "llm_escalate")).alias("llm_calls"), (F.count_if(F.col("route") == "human_review") / F.greatest(F.count_if(F.col("route").isin("human_review", "llm_escalate")), F.lit(1))).alias("abstention"))


def wss_at(predicted: Column, y: Column, target: float = 0.95) -> Column:
    """Work saved over sampling, as an aggregate: null where recall misses the target or there are no positives."""
    recall = F.count_if((y == 1) & (predicted == 1)) / F.when(F.count_if(y == 1) > 0, F.count_if(y == 1))
    return F.when(recall >= target, F.count_if(predicted == 0) / F.count("*") - F.lit(1 - target))


def nmin_compliance(scored: DataFrame, alpha: float = 0.10, delta: float = 0.07) -> DataFrame:
    """Positives by split against the minimum of a certificate."""
    out = scored.groupBy("topic_id").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("m_plus"), *[F.count_if((F.col("y") == 1) & (F.col("is_split") == i)).alias(f"m_{name}") for i, name in enumerate(("score", "calib", "test"))])
    need = n_min(alpha, delta)
    return out.withColumns({"prevalence": F.bround(F.col("m_plus") / F.col("n"), 4), "n_min": need, "margin": (F.col("m_calib") - need).cast("long"), "status": F.when(F.col("m_calib") >= need, "PASS").otherwise("ABSTAIN")})


def cross_topic(rows: DataFrame, columns: list[str], sentinel: float = -999.0) -> DataFrame:
    """Mean, standard error (population deviation) and number of topics; nulls and the sentinel don't count."""
    out = []
    for c in columns:
        v = F.nullif(F.col(c), F.lit(sentinel))
        out += [F.avg(v).alias(f"{c}_mean"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias(f"{c}_se"), F.count(v).alias(f"{c}_n")]
    return rows.agg(*out)


def risk_violations(rows: DataFrame, alpha: str = "alpha") -> DataFrame:
    """How many certified rows miss their risk, and the share that keeps it."""
    bad = F.col("fnr") > F.col(alpha)
    return rows.where(F.col("fnr").isNotNull()).agg(F.count("*").alias("certified"), F.count_if(bad).alias("violations"), F.avg((~bad).cast("double")).alias("pass_rate"))


def slack_ratio(lower: Column, upper: Column) -> Column:
    return F.when(upper > 0, lower / upper)
