"""Topics run side by side in phases; each committed table is kept, and a topic that fails doesn't touch the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .screening_run import is_done


@dataclass(frozen=True)
class Phase:
    """A step of every topic: ``work`` gets the session, the topic and the tables of its earlier phases by name.

    ``at_once`` topics are submitted together: many for a phase that waits for storage, few for one that computes.
    """

    name: str
    work: Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]
    at_once: int = 4


def place(root: str, phase: str, topic: str) -> str:
    return f"{root}/{phase}/{quote(topic, safe='')}"


def run_topics(spark: SparkSession, topics: Iterable[str], phases: list[Phase], root: str, resume: bool = True) -> DataFrame:
    """topic_id, phase, status, error: ``done``, ``kept`` (committed by an earlier run), ``failed`` or ``skipped`` after a failure.

    A phase starts when the one before has ended for all topics. Its jobs carry its name as scheduler pool, so that a
    session in FAIR mode shares executors among them. Only names and messages pass the driver; a topic's table is
    written by the executors under ``root`` and counts once its commit marker is there.
    """
    topics = sorted(set(topics))
    log: list[tuple[str, str, str, str | None]] = []
    alive = dict.fromkeys(topics, True)
    for i, phase in enumerate(phases):

        def step(topic: str, phase: Phase = phase, before: tuple[Phase, ...] = tuple(phases[:i])) -> tuple[str, str, str, str | None]:
            path = place(root, phase.name, topic)
            if not alive[topic]:
                return topic, phase.name, "skipped", None
            if resume and is_done(spark, path):
                return topic, phase.name, "kept", None
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", phase.name)
            try:
                earlier = {p.name: spark.read.parquet(place(root, p.name, topic)) for p in before}
                phase.work(spark, topic, earlier).write.mode("overwrite").parquet(path)
            except Exception as error:  # a topic's failure is a row of the log, whatever its kind
                alive[topic] = False
                return topic, phase.name, "failed", f"{type(error).__name__}: {error}"[:500]
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            return topic, phase.name, "done", None

        with ThreadPoolExecutor(max(1, phase.at_once)) as pool:
            # each task inherits the caller's job properties by a wrapper of its own
            log += [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step), t) for t in topics]]
    return spark.createDataFrame(log, "topic_id string, phase string, status string, error string")


def gathered(spark: SparkSession, topics: Iterable[str], phase: str, root: str) -> DataFrame | None:
    """The committed tables of a phase with their topic_id; None if there is none."""
    parts = [spark.read.parquet(place(root, phase, t)).withColumn("topic_id", F.lit(t)) for t in sorted(set(topics)) if is_done(spark, place(root, phase, t))]
    return reduce(DataFrame.unionByName, parts) if parts else None
