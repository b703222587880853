"""Lexical and dense ranking, fusion, and per-document sentence retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, dot
from ..functions.stemming import plain_words, stem_counts, stems
from ..functions.text import approx_tokens, sentences
from ..session import landed

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def postings(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, tokens: Column, query: list[str], key: str = "doc_id") -> DataFrame:
    """key, score: Okapi BM25 of every document for a query; a query term counts as often as it is there.

    Terms in more than half of the documents get EPSILON times the mean idf of the whole vocabulary. One
    pass makes the lengths; only the query's postings are joined with them.
    """
    sized = docs.select(key, tokens.alias("tokens")).select(key, "tokens", F.size("tokens").alias("dl"))
    stats = sized.agg(F.struct(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).alias("s"))
    vocabulary = sized.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("s.n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    wanted = F.array(*[F.lit(t) for t in query])
    # one row: the mean idf, from how many terms have which document frequency
    mean = vocabulary.groupBy("df").agg(F.count("*").alias("terms")).withColumn("s", stats.scalar()).agg((F.sum(idf * F.col("terms")) / F.sum("terms")).alias("m"))
    terms = vocabulary.where(F.array_contains(wanted, F.col("term"))).withColumn("s", stats.scalar()).select("term", "s.avgdl", F.when(idf < 0, F.lit(EPSILON) * mean.scalar()).otherwise(idf).alias("idf"))
    times = F.aggregate(wanted, F.lit(0), lambda a, t: a + (t == F.col("term")).cast("int"))
    hits = sized.select(key, "dl", F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    # the query's terms: no more rows than the query has words
    scored = hits.join(F.broadcast(terms), "term").withColumn("part", times * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return sized.select(key).join(scored.groupBy(key).agg(F.sum("part").alias("score")), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_stemmed(docs: DataFrame, text: str, query: str, stop: list[str], key: str = "doc_id") -> DataFrame:
    """key, score of the documents with a score: Okapi BM25 over stems, of words without punctuation and stop words.

    One pass lands a row a document, with its stems and their counts; only the stems' document frequencies are
    shuffled, and a document is scored where its row is. ``key`` is unique.
    """
    spark = docs.sparkSession
    found = landed(stem_counts(docs, plain_words(F.col(text), stop), key), "stem-counts")
    n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    idf = F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    vocabulary = landed(found.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("df")), "stem-vocabulary")
    mean = vocabulary.groupBy("df").agg(F.count("*").alias("n")).agg(F.sum(idf * F.col("n")) / F.sum("n")).first()[0] or 0.0
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(plain_words(F.col("q"), stop)).alias("term"))
    asked = asked.join(stems(asked), "term").groupBy("stem").agg(F.count("*").alias("times"))
    weights = vocabulary.withColumn("idf", idf).join(F.broadcast(asked), "stem").select("stem", "times", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")).alias("idf"))
    # the query's stems: no more rows than the query has words
    hits = found.select(key, "dl", F.explode(F.arrays_zip("stems", "tf")).alias("x")).select(key, "dl", F.col("x.stems").alias("stem"), "x.tf")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * n_docs / max(total, 1)))
    return hits.join(F.broadcast(weights), "stem").groupBy(key).agg(F.sum(part).alias("score"))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key, with their rank: a top-k report."""
    best = df.orderBy(F.col(score).desc(), F.col(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def ranked(df: DataFrame, score: str, key: str, keys: list[str], name: str = "rank") -> DataFrame:
    """Rank by falling score within ``keys``, ties by key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(key))))


def dense_scores(vectors: DataFrame, query: list[float], key: str, column: str) -> DataFrame:
    """key, score: cosine with a query vector."""
    return vectors.select(key, cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def rrf(a: Column, b: Column) -> Column:
    """Reciprocal rank fusion of two ranks."""
    return 1.0 / (RRF_K + a) + 1.0 / (RRF_K + b)


def fuse(lexical: DataFrame, dense: DataFrame, key: str, keys: list[str], threshold: float = 0.01) -> DataFrame:
    """keys, key, both ranks, rrf, kept (rrf at least ``threshold``)."""
    l = ranked(lexical, "score", key, keys, "rank_lexical").select(*keys, key, "rank_lexical")
    d = ranked(dense, "score", key, keys, "rank_dense").select(*keys, key, "rank_dense")
    return l.join(d, [*keys, key]).withColumn("rrf", rrf(F.col("rank_lexical"), F.col("rank_dense"))).withColumn("kept", F.col("rrf") >= threshold)


def sentence_hits(docs: DataFrame, keywords: Column, k: int = 5, key: str = "doc_id") -> DataFrame:
    """key, position, sentence, hits: each document's k sentences with most keyword occurrences, in document order.

    A document without a hit gives its first k sentences.
    """
    def count(s: Column) -> Column:
        return F.aggregate(keywords, F.lit(0), lambda a, w: a + F.when(F.contains(F.lower(s), w), 1).otherwise(0))

    scored = F.transform(sentences("text"), lambda s, i: F.struct((-count(s)).alias("minus"), i.alias("position"), s.alias("sentence")))
    good = F.filter(F.col("all"), lambda x: x["minus"] < 0)
    rows = docs.select(key, scored.alias("all"))
    chosen = F.when(F.size(good) > 0, F.slice(F.array_sort(good), 1, k)).otherwise(F.slice("all", 1, k))
    return rows.select(key, F.explode(chosen).alias("x")).select(key, "x.position", "x.sentence", (-F.col("x.minus")).alias("hits"))


def budget_prefix(hits: DataFrame, budget: int = 1500, key: str = "doc_id") -> DataFrame:
    """Sentences in document order until their estimated tokens overflow the budget."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(approx_tokens(F.col("sentence"))).over(w)).where(F.col("used") <= budget)


def section_attention(sections: DataFrame, criterion: Column, vector: str, keys: list[str], label: str, prior: float = 0.5) -> DataFrame:
    """keys, section, weight, p: softmax of scaled products; p is the mean of the highest weight and the prior."""
    score = dot(F.col(vector), criterion) / F.sqrt(F.size(vector).cast("double"))
    w = Window.partitionBy(*keys)
    rows = sections.withColumn("z", score).withColumn("e", F.exp(F.col("z") - F.max("z").over(w))).withColumn("weight", F.col("e") / F.sum("e").over(w))
    best = rows.groupBy(*keys).agg(F.max_by(label, F.struct("weight", -F.col(label))).alias("section"), F.max("weight").alias("weight"))
    return best.withColumn("p", (F.col("weight") + prior) / 2)


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """The successful attempt of the best (lowest) priority of each record; ties by source and address."""
    return attempts.where("success").groupBy(key).agg(F.min_by(F.struct("source", "url"), F.struct("priority", "source", "url")).alias("r")).select(key, "r.*")


def best_url(best: Column, locations: Column) -> Column:
    return F.coalesce(best, F.get(F.filter(locations, lambda x: x["url"].isNotNull()), 0)["url"])
