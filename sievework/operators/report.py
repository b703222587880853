"""Flow counters, audit trails and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW = ["identified", "duplicates", "screened", "abstract_excluded", "sought", "not_retrieved", "assessed", "fulltext_excluded", "included"]


def flow_counts(facts: DataFrame) -> DataFrame:
    """One row of counters of a fact table: record, kept, abstract_decision, retrieved, final_decision."""
    kept, passed, got = F.col("kept"), F.col("abstract_decision") != "EXCLUDE", F.col("retrieved")
    tests = {"identified": F.lit(True), "duplicates": ~kept, "screened": kept, "abstract_excluded": kept & ~passed, "sought": kept & passed, "not_retrieved": kept & passed & ~got, "assessed": kept & passed & got, "fulltext_excluded": kept & passed & got & (F.col("final_decision") == "EXCLUDE"), "included": kept & passed & got & (F.col("final_decision") == "INCLUDE")}
    return facts.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two trackers' counters."""
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])


def reasons(decisions: DataFrame, most: int = 5, length: int = 60) -> DataFrame:
    """reason, n: the most frequent heads of exclusion reasons, a top-k report."""
    return decisions.where("decision = 'EXCLUDE'").groupBy(F.substring("reason", 1, length).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason").limit(most)


def audit_trail(log: DataFrame, stage: str = "stage") -> DataFrame:
    return log.groupBy(stage).agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("models"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def compliance(counts: DataFrame) -> DataFrame:
    """score of required counters that are there, and how many flow steps grow."""
    pairs = [("identified", "screened"), ("screened", "sought"), ("sought", "assessed"), ("assessed", "included")]
    present = sum((F.col(c).isNotNull().cast("int") for c in FLOW), F.lit(0))
    return counts.select((present / len(FLOW)).alias("score"), sum(((F.col(a) < F.col(b)).cast("int") for a, b in pairs), F.lit(0)).alias("warnings"))


def with_mean(rows: DataFrame, label: str, columns: list[str], sentinel: float | None = None) -> DataFrame:
    """A table's rows and their means under the label MEAN; nulls, NaN and a sentinel don't count."""
    def value(c: str):
        v = F.col(c).cast("double")
        bad = F.isnan(v) if sentinel is None else F.isnan(v) | (v == sentinel)
        return F.when(~bad, v)

    return rows.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unionByName(rows.agg(F.lit("MEAN").alias(label), *[F.avg(value(c)).alias(c) for c in columns]))


def summary(topics: DataFrame, certificates: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for every topic, missing and abstained ones, too."""
    rows = topics.select("topic_id").distinct().join(certificates, "topic_id", "left").join(metrics, "topic_id", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("missing")))


def papers(included: DataFrame) -> DataFrame:
    return included.select("pmid", "title", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"))


def validate(summary_rows: DataFrame, alpha: float = 0.10) -> DataFrame:
    """Rows that break a certificate's promise; a sound table has none."""
    return summary_rows.where((F.col("status") == "certified") & ((F.col("fnr") > alpha) | (F.col("tau") <= 0) | (F.col("n_certified") <= 0)))
