"""Reproducible splits, samples and score scaling, by the order of a seeded MD5 instead of a random stream.

Ranks within a stratum are made without gathering it in one task: rows fall into buckets by a prefix of
what they are ordered by, ranks are local to a bucket, and a small table of the buckets' counts shifts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import landed


def draw(seed, key) -> Column:
    """Hex digits that order rows as if at random."""
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, (int, str)) else seed, key).cast("binary"))


def bucketed_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank", method=F.row_number) -> DataFrame:
    """Rank of each row within ``keys``; ``bucket`` must rise with the order and hold equal rows together.

    Adds ``name`` and ``stratum_size``. The counts' table has a row for each stratum and bucket.
    """
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    shifts = counts.select(*keys, "__b", (F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("stratum_size"))
    local = rows.withColumn("__local", method().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return local.join(shifts, [*keys, "__b"]).withColumn(name, F.col("__local") + F.col("__before")).drop("__local", "__before", "__b")


def stratified_split(df: DataFrame, strata: list[str], key: str, seed, shares: list[float], name: str = "is_split") -> DataFrame:
    """Split numbers 0, 1, ... by cumulative shares of each stratum, cut at floor(share * n + 0.5)."""
    d = draw(seed, F.col(key))
    ranked = bucketed_rank(df.withColumn("__d", d), strata, [F.col("__d"), F.col(key)], F.substring("__d", 1, 3), "__r")
    split, total = F.lit(len(shares)), 0.0
    cuts = []
    for share in shares:
        total += share
        cuts.append(F.floor(F.lit(total) * F.col("stratum_size") + 0.5))
    for i in range(len(shares) - 1, -1, -1):
        split = F.when(F.col("__r") <= cuts[i], F.lit(i)).otherwise(split)
    return ranked.withColumn(name, split).drop("__d", "__r", "stratum_size")


def three_way_split(df: DataFrame, seed=20260429, first: float = 0.15, second: float = 0.50) -> DataFrame:
    """is_split 0 (score calibration), 1 (conformal calibration), 2 (test), stratified by topic and label."""
    return stratified_split(df, ["topic_id", "y"], "pmid", seed, [first, second])


def calib_test_split(df: DataFrame, share: float, large_at: int, seed) -> DataFrame:
    """is_calib, stratified by label: 0.8 of topics with at least ``large_at`` positives, else ``share``."""
    counts = df.groupBy("topic_id").agg(F.sum("y").alias("__m"))
    rows = df.join(counts, "topic_id").withColumn("__share", F.when(F.col("__m") >= large_at, 0.8).otherwise(share))
    rows = bucketed_rank(rows.withColumn("__d", draw(seed, F.col("pmid"))), ["topic_id", "y"], [F.col("__d"), F.col("pmid")], F.substring("__d", 1, 3), "__r")
    return rows.withColumn("is_calib", (F.col("__r") <= F.floor(F.col("__share") * F.col("stratum_size") + 0.5)).cast("int")).drop("__m", "__share", "__d", "__r", "stratum_size")


def ensure_split(df: DataFrame, seed=20260429) -> DataFrame:
    """is_split of a frame that may have only is_calib (1 -> 1, 0 -> 2), or nothing (half and half)."""
    if "is_split" in df.columns:
        return df.withColumn("is_split", F.col("is_split").cast("int"))
    if "is_calib" in df.columns:
        return df.withColumn("is_split", F.when(F.col("is_calib").cast("int") == 1, 1).otherwise(2))
    return stratified_split(df, ["topic_id", "y"], "pmid", seed, [0.5], "__h").withColumn("is_split", F.col("__h") + 1).drop("__h")


def subsample_positives(df: DataFrame, m: int, seed=42) -> DataFrame:
    """m calibration positives of each topic, nested in those of any larger m; all other rows stay."""
    is_pos = (F.col("is_split") == 1) & (F.col("y") == 1)
    rows = bucketed_rank(df.withColumn("__p", is_pos.cast("int")).withColumn("__d", draw(F.concat_ws(":", "topic_id", F.lit(seed)), F.col("pmid"))), ["topic_id", "__p"], [F.col("__d"), F.col("pmid")], F.substring("__d", 1, 3), "__r")
    return rows.where((F.col("__p") == 0) | (F.col("__r") <= m)).drop("__p", "__d", "__r", "stratum_size")


def m_grid(m_plus: Column, n_min: Column, candidates: list[int]) -> Column:
    """Sizes of the sensitivity study: candidates between the minimum and all positives, and all of them."""
    inside = F.filter(F.array(*[F.lit(c) for c in candidates]), lambda c: (c >= n_min) & (c <= m_plus))
    return F.array_sort(F.array_distinct(F.concat(inside, F.array(m_plus.cast("int")))))


def borders(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Rough even borders of a column's values, by one pass; they only deal work out, so their error is harmless."""
    return sorted({b for b in df.stat.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.001)})


def bucket_of(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in cuts]), lambda b: b < value)) if cuts else F.lit(0)


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] = ["topic_id"], buckets: int = 256) -> DataFrame:  # noqa: B006
    """keys, q: exact quantiles of ``value`` at ``shares``, interpolated between the neighbours of share * (n - 1).

    Rows shrink to counts of distinct values, so a hot value is one row. Counts of buckets tell which buckets hold the
    places asked for; only those are put in order, each by itself. Nulls don't count; a key with nothing else has null.
    The result, a row a key, is landed: most callers join it more than once.
    """
    by = list(keys) or ["__all"]
    rows = df.withColumns({"__all": F.lit(0), "__v": F.col(value).cast("double")}).select(*by, "__v")
    tally = landed(rows.groupBy(*by, "__v").agg(F.count("*").alias("__n")).withColumn("__b", bucket_of(F.col("__v"), borders(rows.where("__v is not null"), "__v", buckets))), "value-counts")
    sums = tally.groupBy(*by, "__b").agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))), F.lit(0)).alias("__n"))
    w = Window.partitionBy(*by)
    shifts = sums.select(*by, "__b", "__n", F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)).alias("__end"), F.sum("__n").over(w).alias("__total"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("__total") - 1)).alias("at")) for i, q in enumerate(shares)])
    wanted = shifts.select(*by, "__b", (F.col("__end") - F.col("__n")).alias("__start"), "__end", F.explode(places).alias("p")).select("*", F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("__place"))
    wanted = wanted.where((F.col("__place") >= F.col("__start")) & (F.col("__place") < F.col("__end"))).select(*by, "__b", "p", "__place", (F.col("__place") - F.col("__start")).alias("__local"))
    some = tally.where("__v is not null").join(wanted.select(*by, "__b").distinct(), [*by, "__b"], "left_semi")
    upto = some.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    hits = upto.join(wanted, [*by, "__b"]).where((F.col("__local") < F.col("__upto")) & (F.col("__local") >= F.col("__upto") - F.col("__n")))
    ends = hits.groupBy(*by, "p").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
    at = F.col("p.at")
    value_at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(at) - at) * F.col("low") + (at - F.floor(at)) * F.col("high"))
    found = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("p.i", value_at.alias("v")))).alias("f")).select(*by, F.transform("f", lambda x: x["v"]).alias("q"))
    return landed(sums.select(*by).distinct().join(found, by, "left").select(*keys, "q"), "quantiles")


def quantile_scale(df: DataFrame, value: str = "s", buckets: int = 256) -> DataFrame:
    """Each score as rank / N within its topic, ties sharing the lowest rank; constant topics stay.

    One pass finds bucket borders over all scores; they only deal the work out, so their error is harmless.
    """
    bucket = bucket_of(F.col(value), borders(df, value, buckets))
    spread = df.groupBy("topic_id").agg((F.max(value) > F.min(value)).alias("__varies"))
    ranked = bucketed_rank(df, ["topic_id"], [F.col(value)], bucket, "__r", F.rank).join(spread, "topic_id")
    return ranked.withColumn(value, F.when(F.col("__varies"), F.col("__r") / F.col("stratum_size")).otherwise(F.col(value))).drop("__r", "stratum_size", "__varies")


def reliability_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal bins; a score of exactly 1 is in none."""
    b = F.floor(F.col("s") * bins).cast("int")
    return df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_rate"))
