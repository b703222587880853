"""Session defaults and small helpers of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "sievework", **more: str) -> SparkSession:
    """A session with the library's defaults; existing settings win."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | more).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` to a few tasks a core, for work that costs much more than the rows' size tells."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read again: cuts lineage where executors can be lost."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def violations(df: DataFrame, **rules) -> DataFrame:
    """One row: for each named rule the number of rows that break it (null counts as broken)."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, if it has these columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
