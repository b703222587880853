"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Rows whose doc_id is null can't be named in a result and go with the first stage; rows
that share a doc_id are judged each on its own text by the first and third stages, and share the
decision of the second; equal rows share all but their place in the mix; null texts count as empty;
texts of any length are judged and encoded whole; empty tables pass through as empty tables; extra
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm import decontamination, jaccard_join, mixing, quality, token_output
from sievework.llm.common import fresh, staged
from sievework.llm.queries import tokenizer_path

#: Shingles of five words, similarity of 0.8 and more: near duplicates and leaks.
WORDS, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.kept(docs, _table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect, the document with the smallest doc_id stays."""
    found = jaccard_join.jaccard_components(docs, WORDS, PERCENT)
    key = fresh(docs, "id")[0]
    gone = staged(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "pipeline-copies")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"), WORDS, PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    row, key, copies, copy = fresh(docs, "row", "id", "copies", "copy")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows, on = docs.withColumn(row, F.lit(0).cast("long")), [key]
    else:  # rows of one doc_id are told apart by their order; equal rows are alike
        rows, on = docs.withColumn(row, (F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source")) - 1).cast("long")), [key, row]
    mixed = mixing.mix(rows, row=row).where("copies > 0").select(F.col("doc_id").alias(key), F.col("n").alias(row), F.col("copies").alias(copies))
    # one plan at every size: the mix grows with the documents, so it is merged, never broadcast
    joined = rows.withColumn(key, F.col("doc_id").cast("long")).join((mixed if len(on) == 2 else mixed.drop(row)).hint("merge"), on)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{copies}`")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed token files: doc_id, start, n_tokens, ids_crc32 of each document in them."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: SQL can't express the classifier and the sampling; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage's rows written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
