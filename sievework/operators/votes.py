"""Vote ensembles: majority, consistency and merging into a scored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_field


def parse_vote(reply) -> F.Column:
    """Include, Exclude or Uncertain of a JSON reply's ``satisfies``."""
    said = F.lower(json_field(reply, "$.satisfies"))
    return F.when(said == "true", "Include").when(said == "false", "Exclude").otherwise("Uncertain")


def vote_code(vote) -> F.Column:
    return F.when(vote == "Include", 1).when(vote == "Uncertain", 2).otherwise(0)


def vote_of_code(code) -> F.Column:
    return F.when(code == 1, "Include").when(code == 2, "Uncertain").otherwise("Exclude")


def majority(votes: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """keys, n, n_include, n_exclude, majority, u, y_hat. Ties and all-uncertain ensembles are Uncertain, 0, 0.

    With ``size`` only ensembles of exactly so many votes count.
    """
    out = votes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("vote") == "Include").alias("n_include"), F.count_if(F.col("vote") == "Exclude").alias("n_exclude"))
    if size is not None:
        out = out.where(F.col("n") == size)
    inc, exc = F.col("n_include"), F.col("n_exclude")
    label = F.when(inc > exc, "Include").when(exc > inc, "Exclude").otherwise("Uncertain")
    return out.withColumns({"majority": label, "u": F.when(inc == exc, 0.0).otherwise(F.greatest(inc, exc) / F.col("n")), "y_hat": (inc > exc).cast("int")})


def include_share(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The other consistency: the share of Include votes."""
    return votes.groupBy(*keys).agg(F.avg((F.col("vote") == "Include").cast("double")).alias("u"))


def merge_scores(corpus: DataFrame, ensembles: DataFrame, fallback: str | None = "s") -> DataFrame:
    """u and y_hat by document; without an ensemble u is the score ``fallback`` (or 0) and y_hat 0."""
    joined = corpus.join(ensembles.select("pmid", F.col("u").alias("__u"), F.col("y_hat").alias("__y")), "pmid", "left")
    return joined.withColumns({"u": F.coalesce("__u", F.col(fallback) if fallback else F.lit(0.0)), "y_hat": F.coalesce("__y", F.lit(0))}).drop("__u", "__y")


def still_to_call(corpus: DataFrame, votes: DataFrame, size: int) -> DataFrame:
    """Dry run: documents, fully cached ones, hit rate, calls that are still needed."""
    have = votes.groupBy("pmid").agg(F.least(F.count("*"), F.lit(size)).alias("have"))
    rows = corpus.select("pmid").join(have, "pmid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("have") == size).alias("cached"), F.avg((F.col("have") == size).cast("double")).alias("hit_rate"), F.sum(size - F.col("have")).alias("calls"))
