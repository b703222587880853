"""Score calibration: isotonic against logistic, by held-out log-loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import landed
from .splits import stratified_split


def isotonic(train: DataFrame):
    """Pool-adjacent-violators fit of (s, y): (boundaries, predictions)."""
    from pyspark.ml.regression import IsotonicRegression

    from pyspark.ml.functions import array_to_vector

    pooled = train.groupBy("s").agg(F.avg(F.col("y").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(pooled.withColumn("features", array_to_vector(F.array("s"))))
    return list(model.boundaries), list(model.predictions)


def platt(train: DataFrame, reg: float = 0.0) -> tuple[float, float]:
    """Coefficient and intercept of a logistic fit of (s, y). A cost C over n rows is reg = 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression

    from pyspark.ml.functions import array_to_vector

    model = LogisticRegression(regParam=reg, standardization=False, tol=1e-10).fit(train.select(array_to_vector(F.array("s")).alias("features"), F.col("y").cast("double").alias("label")))
    return float(model.coefficients[0]), float(model.intercept)


def apply_isotonic(s: Column, boundaries: list[float], predictions: list[float]) -> Column:
    """Linear interpolation between boundaries, constant outside, in [0, 1]."""
    b, p = F.array(*[F.lit(float(x)) for x in boundaries]), F.array(*[F.lit(float(x)) for x in predictions])
    i = F.size(F.filter(b, lambda x: x <= s))
    n = len(boundaries)
    x0, x1, y0, y1 = F.get(b, i - 1), F.get(b, i), F.get(p, i - 1), F.get(p, i)
    return F.when(i == 0, F.lit(predictions[0])).when(i >= n, F.lit(predictions[-1])).otherwise(F.when(x1 > x0, y0 + (y1 - y0) * (s - x0) / (x1 - x0)).otherwise(y0))


def apply_platt(s: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * s + F.lit(b))))


def losses(rows: DataFrame, p: Column) -> tuple[float, float]:
    """Log-loss and Brier score."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("y").cast("double")
    return tuple(rows.agg(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), F.avg((p - y) * (p - y))).first())


def calibrate(scored: DataFrame, seed=11) -> tuple[DataFrame, dict]:
    """s of all rows calibrated by the better of both on the score-calibration split (is_split 0, 80/20 inside); ties isotonic."""
    own = landed(stratified_split(scored.where("is_split = 0"), ["y"], "pmid", seed, [0.8], "__part"), "calibration")
    train, test = own.where("__part = 0"), own.where("__part = 1")
    iso, log = isotonic(train), platt(train)
    by = {"isotonic": losses(test, apply_isotonic(F.col("s"), *iso)), "platt": losses(test, apply_platt(F.col("s"), *log))}
    chosen = "isotonic" if by["isotonic"][0] <= by["platt"][0] else "platt"
    new = apply_isotonic(F.col("s"), *iso) if chosen == "isotonic" else apply_platt(F.col("s"), *log)
    return scored.withColumn("s_raw", F.col("s")).withColumn("s", F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0))), {"chosen": chosen, "losses": by}
