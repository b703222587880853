"""Inputs of the screening operators, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import quantile_scale, three_way_split
from ..operators.votes import majority, merge_scores
from ..session import table


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pmid, slot, vote of the order lines."""
    label = F.when(F.col("l_returnflag") == "A", "Include").when(F.col("l_returnflag") == "R", "Exclude").otherwise("Uncertain")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("slot"), label.alias("vote"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, pmid, s (the price, not scaled), y."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic_id"), F.col("o_orderkey").alias("pmid"), F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, pmid, s, u, y, y_hat, is_split: the scored corpus."""
    rows = quantile_scale(orders(spark, sf_dir))
    rows = merge_scores(rows, majority(votes(spark, sf_dir), ["pmid"]))
    return three_way_split(rows).select("topic_id", "pmid", "s", "u", "y", "y_hat", "is_split")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_id, pmid, rank: orders by falling price within their priority: a ranking."""
    from ..operators.ranking import ranked

    return ranked(orders(spark, sf_dir), "s", "pmid", ["topic_id"]).select("topic_id", "pmid", F.col("rank").cast("long").alias("rank"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("topic_id", "pmid", F.col("y").alias("rel"))
