"""Coverage and completeness of a collected corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_counts(records: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """year, n, flagged (below mean - 2 population deviations); nothing with fewer than three years before the range."""
    counts = records.where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row for each year
    rows = counts.withColumn("__years", F.count("*").over(w)).where("__years >= 3")
    if first is not None and last is not None:
        rows = rows.where(F.col("year").between(first, last))
    return rows.withColumn("flagged", F.col("n") < F.avg("n").over(w) - 2 * F.stddev_pop("n").over(w)).drop("__years")


def term_coverage(docs: DataFrame, terms: list[str], text: str = "text", least: float = 0.05) -> DataFrame:
    """term, n_docs, fraction, covered: in one pass over the documents, whatever the number of terms."""
    held = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))
    total = docs.agg(F.count("*").alias("t"))
    hits = docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    every = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    out = every.join(hits, "term", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).withColumn("fraction", F.col("n_docs") / total.scalar())
    return out.withColumn("covered", F.col("fraction") >= least)


def saturation(total: Column, before: Column) -> tuple[Column, Column]:
    """New records, and whether they are under 5 % of all; null where there was nothing before."""
    new = F.greatest(F.lit(0), total - before)
    return new, F.when(before > 0, new / total < 0.05)


def completeness(records: DataFrame, targets: int) -> DataFrame:
    """Share of the target databases seen, years seen, coefficient of variation of the years' counts, saturated below 0.5."""
    years = records.where("year is not null").groupBy("year").agg(F.count("*").alias("n")).agg(F.struct(F.count("*").alias("n_years"), (F.stddev_pop("n") / F.avg("n")).alias("cv")).alias("y"))
    out = records.agg((F.count_distinct("source") / F.lit(targets)).alias("db_coverage"), F.count("*").alias("n_records")).withColumn("y", years.scalar())
    return out.select("db_coverage", "n_records", "y.n_years", "y.cv").withColumn("saturated", F.col("cv") < 0.5)
