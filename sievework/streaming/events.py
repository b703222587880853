"""The run's event feed as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, type string, stage string, pmid string, s double, u double, route string, decision string, elapsed_seconds double"


def feed(spark: SparkSession, folder: str, schema: str = SCHEMA, fmt: str = "json") -> DataFrame:
    """Events of a folder, file by file as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).format(fmt).load(folder)


def stage_counts(events: DataFrame, key: str = "type", lateness: str | None = None, width: str | None = None) -> DataFrame:
    """Events per key; with lateness and width per window of event time, late data beyond the watermark left out."""
    if lateness and width:
        return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return events.groupBy(key).agg(F.count("*").alias("n"))


def messages(events: DataFrame) -> DataFrame:
    """Events as the messages a viewer gets."""
    kind = F.create_map(*[F.lit(x) for x in ("pipeline.stage_complete", "stage", "screening.route_decision", "route", "benchmark.evaluation", "evaluation", "search.query_executed", "search", "screening.abstract_decision", "abstract")])
    return events.where(F.try_element_at(kind, F.col("type")).isNotNull()).select(F.try_element_at(kind, F.col("type")).alias("message"), F.to_json(F.struct("*")).alias("data"))


def every_tenth(events: DataFrame, key: str = "type", n: int = 10) -> DataFrame:
    """key, seen: a row for every n-th event of a key, with a counter that outlives micro-batches."""
    import pandas as pd

    def count(name: tuple, parts, state):
        seen = state.get[0] if state.exists else 0
        out = []
        for part in parts:
            for _ in range(len(part)):
                seen += 1
                if seen % n == 0:
                    out.append((name[0], seen))
        state.update((seen,))
        yield pd.DataFrame(out, columns=[key, "seen"])

    return events.groupBy(key).applyInPandasWithState(count, f"{key} string, seen long", "seen long", "append", "NoTimeout")
