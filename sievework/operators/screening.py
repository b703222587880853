"""Criterion judgments to probabilities, decisions, penalties and flags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, confidence, cosine, decide, indel_ratio, noisy_or, p_satisfy
from .splits import quantiles

MISMATCH = "abstract_fulltext_pico_mismatch"
#: Domains of the two risk-of-bias tools.
ROB2, NOS = 5, 3


def judged(judgments: DataFrame) -> DataFrame:
    return judgments.withColumn("p", p_satisfy(F.col("satisfies"), F.col("confidence")))


def fused(judgments: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """keys, n_criteria, p_include (to 12 places, so that ties with a threshold don't depend on the order of the factors), decision, confidence by noisy-or; no judgments: 0.5 of the caller's left join."""
    out = judgments.groupBy(*keys).agg(F.count("*").alias("n_criteria"), F.round(clamp(noisy_or(F.col(p))), 12).alias("p_include"))
    return out.withColumns({"decision": decide(F.col("p_include")), "confidence": confidence(F.col("p_include"))})


def screen(records: DataFrame, judgments: DataFrame, key: str = "record_id") -> DataFrame:
    """A decision for every record; without judgments UNCERTAIN at 0.5."""
    out = records.select(key).join(fused(judgments, [key]), key, "left").withColumn("p_include", F.coalesce("p_include", F.lit(0.5)))
    return out.withColumns({"n_criteria": F.coalesce("n_criteria", F.lit(0)), "decision": decide(F.col("p_include")), "confidence": confidence(F.col("p_include"))})


def span_penalty(p: Column, span: Column, verified: Column) -> Column:
    """An evidence span that the text doesn't have takes the probability down to 0.30 of it."""
    return F.when((F.trim(F.coalesce(span, F.lit(""))) != "") & ~F.coalesce(verified, F.lit(False)), p * 0.30).otherwise(p)


def verify_spans(rows: DataFrame, span: str, text: str, threshold: float = 0.85) -> DataFrame:
    """verified: the span is in the text - exactly, ignoring case, or with an indel ratio of a window of its length.

    The two plain tests run in the JVM; only what they leave open goes to the windows, and of these only the ones
    that share enough characters, in whatever order, with the span.
    """
    def shared(a: str, b: str) -> int:  # no common subsequence is longer
        return sum(min(a.count(c), b.count(c)) for c in set(a))

    @F.pandas_udf("boolean")
    def near(spans: pd.Series, texts: pd.Series) -> pd.Series:
        def test(s, t) -> bool:
            n, step = len(s), max(1, len(s) // 2)
            least = threshold * (n + min(n, len(t))) / 2 - 1e-6
            if shared(s, t) < least:
                return False
            starts = {*range(0, max(1, len(t) - n + 1), step), max(0, len(t) - n)}
            return any(shared(s, t[i:i + n]) >= least and indel_ratio(s, t[i:i + n]) >= threshold for i in starts)

        return pd.Series([bool(s) and bool(t) and test(s.lower(), t.lower()) for s, t in zip(spans, texts, strict=True)])

    plain = F.contains(F.col(text), F.col(span)) | F.contains(F.lower(text), F.lower(span))
    blank = F.trim(F.coalesce(span, F.lit(""))) == ""
    open_ = F.when(~blank & ~F.coalesce(plain, F.lit(False)), F.col(span))
    return rows.withColumn("verified", F.when(blank, False).when(plain, True).otherwise(near(F.coalesce(open_, F.lit("")), F.when(open_.isNotNull(), F.col(text)).otherwise(""))))


def tier(tokens: Column) -> Column:
    return F.when(tokens < 3000, "direct").when(tokens <= 12_000, "hierarchical").otherwise("retrieval")


def prior(probabilities: Column, criterion: Column) -> Column:
    return F.coalesce(F.try_element_at(probabilities, criterion), F.lit(0.5))


def final_decision(p: Column, flags: Column) -> tuple[Column, Column]:
    """Probability after the mismatch penalty, and the decision."""
    out = clamp(F.when(F.array_contains(flags, MISMATCH), p * 0.80).otherwise(p))
    return out, decide(out)


def alignment_flags(a: Column, b: Column, least: float = 0.60) -> tuple[Column, Column]:
    """Clamped cosine of two summaries, and the mismatch flag below ``least``."""
    c = clamp(cosine(a, b))
    return c, F.when(c < least, F.array(F.lit(MISMATCH))).otherwise(F.array().cast("array<string>"))


def first_exclusion(judgments: DataFrame, key: str, length: int = 80) -> DataFrame:
    """key, reason: head of the first criterion, in order, that excludes."""
    return judgments.where(decide(F.col("p")) == "EXCLUDE").groupBy(key).agg(F.substring(F.min_by("criterion_text", F.struct("criterion_order", "criterion_text")), 1, length).alias("reason"))


def flag_threshold(rows: DataFrame) -> DataFrame:
    """One row, threshold: p75 if it flags at most 400, p85 at most 250, p90 at most 150, else p95."""
    q = quantiles(rows, "p", [0.75, 0.85, 0.9, 0.95], [])
    n = rows.withColumn("q", q.scalar()).agg(F.first("q").alias("q"), *[F.count_if(F.col("p") >= F.get("q", i)).alias(f"n{i}") for i in range(3)])
    return n.select(F.when(F.col("n0") <= 400, F.get("q", 0)).when(F.col("n1") <= 250, F.get("q", 1)).when(F.col("n2") <= 150, F.get("q", 2)).otherwise(F.get("q", 3)).alias("threshold"))


def flag_failures(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """final: UNCERTAIN stays; others are UNCERTAIN from the threshold up, else EXCLUDE."""
    keep = (F.col("decision") == "UNCERTAIN") | (F.col("p") >= threshold.scalar())
    return rows.withColumn("final", F.when(keep, "UNCERTAIN").otherwise("EXCLUDE"))


def worst_bias(domains: DataFrame, key: str) -> DataFrame:
    """Overall risk of bias: the worst domain; unknown judgments are some_concerns."""
    j = F.regexp_replace(F.lower(F.trim("judgment")), r"[\s-]+", "_")
    rank = F.when(j == "low", 0).when(j == "high", 2).otherwise(1)
    return domains.groupBy(key).agg(F.max(rank).alias("r")).select(key, F.get(F.array(F.lit("low"), F.lit("some_concerns"), F.lit("high")), F.col("r")).alias("overall"))


def bias_tool(design: Column) -> Column:
    d = F.lower(F.coalesce(design, F.lit("")))
    return F.when(F.contains(d, F.lit("random")) | F.contains(d, F.lit("rct")), "RoB2").otherwise("NOS")


def refine_mode(n: Column, gaps: Column) -> Column:
    return F.when(n < 20, "RELAX").when(n > 5000, "NARROW").when(gaps, "FILL_GAPS")
