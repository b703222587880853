"""A scored corpus with known distributions, drawn by hashes of its ids: the same rows in any order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import draw


def uniform(seed, key, name: str, i: int | None = None) -> Column:
    """A number in (0, 1] of the first 13 hex digits of the seeded MD5 of ``name`` (and a number) and the key."""
    label = F.concat_ws(":", F.lit(name if i is None else f"{name}{i}"), key)
    return (F.conv(F.substring(draw(seed, label), 1, 13), 16, 10).cast("long") + 1) / F.lit(4503599627370496.0)


def beta(seed, key, name: str, a: int, b: int) -> Column:
    """A draw of Beta(a, b) for whole a and b: the a-th smallest of a + b - 1 uniform draws has exactly this distribution."""
    return F.get(F.array_sort(F.array(*[uniform(seed, key, name, i) for i in range(a + b - 1)])), a - 1)


def beta_mixture(ids: DataFrame, key: str = "pmid", seed=0, prevalence: float = 0.05, flips: float = 0.10, band: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """The columns of ``ids`` with y, s, u, y_hat: positives at ``prevalence`` score by Beta(8, 2), others by Beta(2, 8), u by Beta(5, 5).

    Votes equal the label, but for a share of ``flips`` of those with s in the band. No shuffle: each row depends on its id only.
    Rows of one id are equal; a null id draws as one of its own would, all null ids alike. Columns of these names are replaced.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = ids.withColumn("y", (uniform(seed, k, "y") <= prevalence).cast("int"))
    rows = rows.withColumns({"s": F.when(F.col("y") == 1, beta(seed, k, "p", 8, 2)).otherwise(beta(seed, k, "n", 2, 8)), "u": beta(seed, k, "u", 5, 5)})
    flip = (uniform(seed, k, "f") <= flips) & F.col("s").between(*band)
    return rows.withColumn("y_hat", F.when(flip, 1 - F.col("y")).otherwise(F.col("y")))
