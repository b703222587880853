"""Readers and writers of relevance judgments, topics, runs and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import medline_doi, medline_year, strip, strip_markup

CORPUS = "pmid string, title string, abstract string, y_abstract tinyint, is_calib tinyint"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number in it; fields split at white space."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.withColumn("f", F.split(F.trim("value"), r"\s+"))


def strict_qrels(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, iteration, pmid, rel of a four-field file; comments and blank lines skipped, anything else is an error."""
    rows = _fields(spark, path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    good = (F.size("f") == 4) & F.get("f", 3).isin("0", "1")
    rel = F.when(good, F.get("f", 3).cast("int")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": bad line: "), F.col("value"))).cast("int"))
    return rows.select(F.get("f", 0).alias("topic_id"), F.get("f", 1).alias("iteration"), F.get("f", 2).alias("pmid"), rel.alias("rel"), "line")


def topic_qrels(spark: SparkSession, path: str, topic_id: str) -> DataFrame:
    """pmid, rel of one topic; of repeated ids the last line wins."""
    return strict_qrels(spark, path).where(F.col("topic_id") == topic_id).groupBy("pmid").agg(F.max_by("rel", "line").alias("rel"))


def lenient_qrels(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, pmid, rel: rel is 1 where the field is "1", else 0; malformed lines are skipped."""
    rows = _fields(spark, path).where(F.size("f") >= 4)
    return rows.select(F.get("f", 0).alias("topic_id"), F.get("f", 2).alias("pmid"), (F.get("f", 3) == "1").cast("int").alias("rel"), "line").groupBy("topic_id", "pmid").agg(F.max_by("rel", "line").alias("rel"))


def topic_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, folder).where(F.trim("value") != "").select(F.get("f", 0).alias("topic_id")).distinct()


def topic_file(spark: SparkSession, path: str) -> DataFrame:
    """title, query, pmids of a file with Title:, Query: and Pids: blocks."""
    whole = spark.read.text(path, wholetext=True)

    def block(name: str) -> Column:
        return strip(F.regexp_extract("value", rf"(?ms)^{name}:[\x20\t]*(.*?)(?=^\w+:|\z)", 1))

    pids = F.filter(F.split(block("Pids"), r"\s+"), lambda p: p.rlike("^[0-9]+$"))
    return whole.select(block("Title").alias("title"), F.regexp_replace(block("Query"), r"\s+", " ").alias("query"), pids.alias("pmids"))


def two_column_topics(spark: SparkSession, pids: str, titles: str) -> DataFrame:
    """topic_id, title, pmids of a .pids and a .title file."""
    p = _fields(spark, pids).where(F.size("f") >= 2).groupBy(F.get("f", 0).alias("topic_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.get("f", 1).alias("p")))), lambda s: s["p"]).alias("pmids"))
    t = spark.read.text(titles).select(F.split("value", r"\s+", 2).alias("f")).select(F.get("f", 0).alias("topic_id"), F.trim(F.get("f", 1)).alias("title"))
    return p.join(t, "topic_id", "left")


def canonical_pmids(spark: SparkSession, path: str) -> DataFrame:
    """pmid column of a Parquet corpus without nulls, or the ids of a text file with an optional Pids: line."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("pmid").dropna()
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s*Pids:", "")).alias("pmid")).where(F.col("pmid").rlike("^[0-9]+$"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, action, pmid, rank, score, run of a six-field run file."""
    rows = _fields(spark, path).where(F.size("f") >= 6)
    return rows.select(*[F.get("f", i).cast(t).alias(n) for i, (n, t) in enumerate((("topic_id", "string"), ("action", "string"), ("pmid", "string"), ("rank", "int"), ("score", "double"), ("run", "string")))])


def run_lines(ranked: DataFrame) -> DataFrame:
    """value: run-file lines of (topic_id, pmid, rank, assessed): AF where assessed, else NF; score falls with rank."""
    return ranked.select(F.concat_ws("\t", "topic_id", F.when(F.col("assessed"), "AF").otherwise("NF"), "pmid", F.col("rank"), (1 - F.col("rank")).cast("string"), F.lit("run")).alias("value"))


def write_run(ranked: DataFrame, path: str) -> None:
    run_lines(ranked.orderBy("topic_id", "rank")).write.mode("overwrite").text(path)


def ranked_labels(ranking: DataFrame, qrels: DataFrame, least: int = 100) -> DataFrame:
    """Per topic of at least so many documents the ranked ids with aligned labels; a missing label is 0."""
    rows = ranking.join(qrels, ["topic_id", "pmid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    per = rows.groupBy("topic_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "pmid", "rel"))).alias("r")).where(F.col("n") >= least)
    return per.select("topic_id", F.col("r.pmid").alias("pmids"), F.col("r.rel").alias("labels"))


def medline_records(records: DataFrame) -> DataFrame:
    """Candidate records of MEDLINE fields (pmid, ti, ab, jt, dp, aid, lid, au); blank titles are dropped."""
    rows = records.where(F.trim(F.coalesce("ti", F.lit(""))) != "")
    return rows.select(F.lit("pubmed").alias("source_database"), F.col("pmid").alias("external_id"), F.trim("ti").alias("title"), F.col("ab").alias("abstract"), F.col("au").alias("authors"), F.col("jt").alias("journal"), medline_year("dp").alias("year"), medline_doi(F.col("aid"), F.col("lid")).alias("doi"), "pmid")


#: Stands between two strings of one XPath result; no XML text can hold it.
APART = "\uffff"


def article_records(xml: DataFrame, column: str = "xml") -> DataFrame:
    """pmid, title, abstract, mesh of article XML; articles without an id are dropped.

    Each path parses the text anew, so both strings come from one, and the generated row keeps the filter on the id
    from evaluating any of them again.
    """
    def nodes(path: str) -> Column:
        return F.xpath(F.col(column), F.lit(path))

    def one(i: int) -> Column:
        return F.nullif(strip_markup(F.get(F.split("heads", APART), i)), F.lit(""))

    heads = F.xpath_string(F.col(column), F.lit(f"concat(//MedlineCitation/PMID, '{APART}', //ArticleTitle)"))
    parsed = xml.select(F.inline(F.array(F.struct(heads.alias("heads"), nodes("//Abstract/AbstractText/text()").alias("texts"), nodes("//MeshHeading/DescriptorName/text()").alias("mesh")))))
    return parsed.select(one(0).alias("pmid"), one(1).alias("title"), F.nullif(F.array_join("texts", " "), F.lit("")).alias("abstract"), "mesh").where("pmid is not null")


def scholar_records(items: DataFrame, column: str = "item") -> DataFrame:
    """Candidate records of JSON items of a paper search."""
    def j(path: str) -> Column:
        return F.get_json_object(F.col(column), path)

    authors = F.from_json(j("$.authors"), "array<struct<name:string>>")
    return items.select(F.lit("semantic_scholar").alias("source_database"), F.coalesce(j("$.openAccessPdf.url"), j("$.paperId")).alias("external_id"), j("$.title").alias("title"), j("$.abstract").alias("abstract"), F.transform(authors, lambda a: a["name"]).alias("authors"), j("$.venue").alias("journal"), j("$.year").cast("int").alias("year"), j("$.externalIds.DOI").alias("doi"), j("$.externalIds.PubMed").alias("pmid")).where("title is not null")


def missing_ids(wanted: DataFrame, cache: DataFrame, key: str = "pmid") -> DataFrame:
    """Wanted ids that a cache hasn't; with it, only misses are fetched."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def with_text(rows: DataFrame) -> DataFrame:
    """Rows with a title and an abstract."""
    return rows.where((F.length(F.trim("title")) > 0) & (F.length(F.trim("abstract")) > 0))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources' records, not deduplicated; columns that a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_corpus(rows: DataFrame, path: str) -> None:
    """The core corpus, one folder per topic where there are topics."""
    names = [c.split()[0] for c in CORPUS.split(", ")]
    cast = rows.select(*([F.col("topic_id")] if "topic_id" in rows.columns else []), *[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in CORPUS.split(", "))])
    writer = cast.write.mode("overwrite")
    (writer.partitionBy("topic_id") if "topic_id" in cast.columns else writer).parquet(path)
    missing = set(names) - set(rows.sparkSession.read.parquet(path).columns)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def flat_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("authors", F.to_json("authors"))


def from_flat(rows: DataFrame) -> DataFrame:
    """Candidates of flat rows; NaN is null."""
    return rows.withColumn("authors", F.from_json("authors", "array<string>")).withColumn("year", F.when(~F.isnan(F.col("year").cast("double")), F.col("year").cast("int")))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
