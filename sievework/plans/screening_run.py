"""The certified screening run as ordered stages whose tables are landed, skipped when done and resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, certify, routing, splits
from ..operators.report import summary
from . import corpus

Stage = Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]


def _scores(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return corpus.scored(spark, sf_dir)


def _calibrated(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return calibration.calibrate(splits.ensure_split(done["scores"]))[0]


def _certified(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return certify.certify(done["calibrated"].where("is_split = 1"))


def _routes(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return routing.routed(done["calibrated"].where("is_split = 2"), done["certificate"].where("status = 'certified'"))


def _metrics(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return routing.evaluate(done["routes"])


def _summary(spark: SparkSession, sf_dir: str, done: dict[str, DataFrame]) -> DataFrame:
    return summary(done["scores"].select("topic_id"), done["certificate"], done["metrics"])


STAGES: dict[str, Stage] = {"scores": _scores, "calibrated": _calibrated, "certificate": _certified, "routes": _routes, "metrics": _metrics, "summary": _summary}


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, sf_dir: str, root: str, resume: bool = True, only: list[str] | None = None) -> DataFrame:
    """Run the stages in order, each landed under ``root``; committed ones are read instead. Returns the last one."""
    done: dict[str, DataFrame] = {}
    for name, stage in STAGES.items():
        if only is not None and name not in only and not is_done(spark, f"{root}/{name}"):
            continue
        if not (resume and is_done(spark, f"{root}/{name}")):
            stage(spark, sf_dir, done).write.mode("overwrite").parquet(f"{root}/{name}")
        done[name] = spark.read.parquet(f"{root}/{name}")
    return done[list(done)[-1]]


def preflight(df: DataFrame) -> DataFrame:
    """check, status: a scored corpus' preconditions before a run."""
    need = {"topic_id", "pmid", "s", "u", "y"}
    facts = df.agg(F.count("*").alias("n"), F.max("s").alias("top"), F.count_if(F.col("y") == 1).alias("m")) if need <= set(df.columns) else df.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(0.0).alias("top"), F.lit(0).alias("m"))
    tests = {"columns": F.lit(need <= set(df.columns)), "rows": F.col("n") > 0, "scores": F.coalesce(F.col("top") > 0, F.lit(False)), "positives": F.col("m") > 0}
    return facts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.when(t, "PASS").otherwise("FAIL").alias("status")) for k, t in tests.items()])).alias("c")).select("c.*")
