"""Stores as tables: protocols, artefacts, decisions, votes, certificates, run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITERION = "struct<criterion_id:string,text:string,type:string,pico_element:string>"
PROTOCOL = f"title string, research_question string, pico struct<population:string,intervention:string,comparator:string,outcome:string,study_design:string>, inclusion_criteria array<{CRITERION}>, exclusion_criteria array<{CRITERION}>, target_databases array<string>, date_range array<int>, language_restrictions array<string>, max_papers_per_db int, pubmed_query_override string, benchmark struct<topic_id:string,qrels_path:string,evaluation_mode:string,canonical_pmids_path:string>"
VOTE_KEY = ["model_id", "prompt_sha", "pmid", "temperature", "seed_b", "template_v"]


def criteria(c) -> F.Column:
    """Criteria with an identifier and a known type; unknown types are MANDATORY."""
    return F.transform(F.coalesce(c, F.array().cast(f"array<{CRITERION}>")), lambda x: F.struct(F.coalesce(x["criterion_id"], F.sha2(x["text"], 256)).alias("criterion_id"), x["text"].alias("text"), F.when(F.upper(x["type"]) == "DESIRABLE", "DESIRABLE").otherwise("MANDATORY").alias("type"), x["pico_element"].alias("pico_element")))


def load_protocol(spark: SparkSession, path: str, design: str = "RCT") -> DataFrame:
    """One review protocol of a JSON file."""
    raw = spark.read.schema(PROTOCOL).json(path, multiLine=True)
    pico = F.col("pico").withField("study_design", F.coalesce("pico.study_design", F.lit(design)))
    return raw.withColumns({"pico": pico, "inclusion_criteria": criteria(F.col("inclusion_criteria")), "exclusion_criteria": criteria(F.col("exclusion_criteria")), "max_papers_per_db": F.coalesce("max_papers_per_db", F.lit(1000))})


def put_artefact(content: DataFrame, root: str, kind: str, version: str) -> None:
    """Write one version of an artefact; unknown kinds go to misc."""
    kind = kind if kind.isidentifier() else "misc"
    content.write.mode("overwrite").parquet(f"{root}/artifact_type={kind}/version={version}")


def get_artefact(spark: SparkSession, root: str, kind: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/artifact_type={kind}/version={version}")


def versions(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/artifact_type={kind}").select("version").distinct().orderBy("version")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins, by map-side combined aggregation of whole rows."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def decisions_of(log: DataFrame, **where) -> DataFrame:
    """Decisions of a record or a stage, in order of time."""
    for k, v in where.items():
        log = log.where(F.col(k) == v)
    return log.orderBy("timestamp")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def first_votes(votes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idempotent insert: the first row of each key stays."""
    rest = [c for c in votes.columns if c not in keys]
    return votes.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def cached(wanted: DataFrame, votes: DataFrame, keys: list[str] = VOTE_KEY) -> DataFrame:
    return wanted.join(votes, keys)


def ensemble(votes: DataFrame, keys: list[str], size: int, slot: str = "seed_b") -> DataFrame:
    """The first ``size`` votes of each key by slot."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(slot)
    return votes.withColumn("slot_rank", F.row_number().over(w)).where(F.col("slot_rank") <= size)


def vote_stats(votes: DataFrame, slot: str = "seed_b") -> DataFrame:
    """Votes and distinct documents per slot."""
    return votes.groupBy(slot).agg(F.count("*").alias("votes"), F.count_distinct("pmid").alias("documents"))


def without_empty(votes: DataFrame) -> DataFrame:
    """Votes whose response isn't null, blank or an empty object."""
    return votes.where(~F.coalesce(F.trim("response").isin("{}", ""), F.lit(True)))


def with_label(votes: DataFrame) -> DataFrame:
    """vote_label of a store that has only the code; unknown codes are Uncertain."""
    label = F.when(F.col("verdict") == 1, "Include").when(F.col("verdict") == 0, "Exclude").otherwise("Uncertain")
    return votes if "vote_label" in votes.columns else votes.withColumn("vote_label", label)


def merge_stores(stores: list[DataFrame], keys: list[str] = VOTE_KEY, order: str = "created_at") -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return first_votes(out, keys, order)


def split_by_topic(votes: DataFrame, topics: DataFrame, root: str) -> int:
    """Write a store partitioned by topic; votes of unknown documents are left out, their number is returned. A shared document goes to its last topic."""
    last = topics.groupBy("pmid").agg(F.max("topic_id").alias("topic_id"))
    votes.join(last, "pmid").write.mode("overwrite").partitionBy("topic_id").parquet(root)
    return votes.join(last, "pmid", "left_anti").count()


def emit(events: DataFrame, path: str) -> None:
    """Append run events with their UTC time as JSON lines."""
    events.withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp()) if "ts" in events.columns else F.current_timestamp()).write.mode("append").json(path)


def save_certificate(grid: DataFrame, summary: DataFrame, root: str) -> None:
    """A certificate: a row per topic, and its grid."""
    grid.write.mode("overwrite").partitionBy("topic_id").parquet(f"{root}/grid")
    summary.write.mode("overwrite").parquet(f"{root}/summary")


def load_certificate(spark: SparkSession, root: str, topic_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    grid, summary = spark.read.parquet(f"{root}/grid"), spark.read.parquet(f"{root}/summary")
    return (grid, summary) if topic_id is None else (grid.where(F.col("topic_id") == topic_id), summary.where(F.col("topic_id") == topic_id))


def unfinished(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Grid rows that a partial result has not: what a resumed run still has to do."""
    return grid.join(done.select("topic_id", "theta_idx"), ["topic_id", "theta_idx"], "left_anti")
