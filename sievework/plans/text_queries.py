"""Queries of the text, ranking, fusion, dedup, evaluation and report operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import cosine, unit
from ..operators import baselines, coverage, dedup, evaluator, learning, neighbours, ranking, replies, report, retrieval, review, routing, screening
from ..session import landed, table
from ..sources import judgments, stores
from ..streaming import events as feed
from . import corpus
from .screening_queries import SCORED, _with

QUERY = ["thion", "thea", "onst", "reer", "thea", "ndre"]
TERMS = ["idiot", "thea", "onst", "eaux", "keit", "ciones", "zzzzzz", "token"]
KEYWORDS = ["thea", "onst", "eaux", "keit", "ción"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _every(parts, n: int, k: int):
    """The k-th of every n parts of a text."""
    return F.filter(parts, lambda x, i: i % n == k)


def _judgments(spark, d):
    """record_id, criterion_order, criterion_id, satisfies, confidence of the order lines: a criterion each."""
    said = F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "R", "false").otherwise("unclear")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("criterion_order"), F.col("l_partkey").alias("criterion_id"), F.concat(F.lit("criterion "), F.col("l_partkey")).alias("criterion_text"), said.alias("satisfies"), (F.col("l_quantity") / 60).alias("confidence"))


JUDGED = """j AS (SELECT l_orderkey AS record_id, l_linenumber AS criterion_order, l_partkey AS criterion_id, 'criterion ' || l_partkey AS criterion_text,
  CASE l_returnflag WHEN 'A' THEN least(greatest(l_quantity / 60, 0), 1) WHEN 'R' THEN least(1 - least(greatest(l_quantity / 60, 0), 1), 0.3::DOUBLE) ELSE 0.5::DOUBLE END AS p FROM lineitem),
fused AS (SELECT record_id, count(*) AS n_criteria, round(least(greatest(1 - product(1 - p), 0), 1), 12) AS p_include FROM j GROUP BY record_id)"""
DECIDE = "CASE WHEN {p} >= 0.7::DOUBLE THEN 'INCLUDE' WHEN {p} <= 0.25::DOUBLE THEN 'EXCLUDE' ELSE 'UNCERTAIN' END"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.SEARCH_STOPWORDS) + "]"
SEARCH = f"list_filter({TOKENS}, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))"


def p_satisfy_map(spark, d):
    return _round(screening.judged(_judgments(spark, d)).select("record_id", "criterion_order", "criterion_id", "p"), "p")


def noisy_or_decision(spark, d):
    return _round(screening.fused(screening.judged(_judgments(spark, d)), ["record_id"]), "p_include", "confidence")


def screen_all(spark, d):
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    return _round(screening.screen(records, screening.judged(_judgments(spark, d)).where("satisfies <> 'unclear'")), "p_include", "confidence")


def pico_penalty_decision(spark, d):
    flags = F.when(F.col("n_criteria") > 4, F.array(F.lit(screening.MISMATCH))).otherwise(F.array().cast("array<string>"))
    p, decision = screening.final_decision(F.col("p_include"), flags)
    return _round(screening.fused(screening.judged(_judgments(spark, d)), ["record_id"]).select("record_id", p.alias("p"), decision.alias("decision")), "p")


def first_exclusion_reason(spark, d):
    return screening.first_exclusion(screening.judged(_judgments(spark, d)), "record_id")


def exclusion_top5(spark, d):
    rows = screening.first_exclusion(screening.judged(_judgments(spark, d)), "record_id").withColumn("decision", F.lit("EXCLUDE"))
    return report.reasons(rows)


def smart_flag_threshold(spark, d):
    rows = landed(screening.fused(screening.judged(_judgments(spark, d)), ["record_id"]).select("record_id", F.round("p_include", 6).alias("p"), "decision"), "flags")
    return screening.flag_failures(rows, screening.flag_threshold(rows)).groupBy("decision", "final").agg(F.count("*").alias("n"))


def tier_routing(spark, d):
    return _docs(spark, d).select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens")).withColumn("tier", screening.tier(F.col("tokens")))


def bias_overall(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", " Low ").when(F.col("l_returnflag") == "R", "high").otherwise("some concerns").alias("judgment"))
    return screening.worst_bias(rows, "l_orderkey")


def bm25_scores(spark, d):
    return _round(ranking.bm25(_docs(spark, d), tx.search_tokens(tx.text_or_empty("text")), QUERY), "score")


def bm25_topk(spark, d):
    return ranking.top(bm25_scores(spark, d), "score", "doc_id", 20)


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows, [float(x) for x in rows.orderBy("vec_id").limit(1).first()["embedding"]]


def bm25_stemmed_topk(spark, d):
    from pyspark.ml.feature import StopWordsRemover

    found = ranking.bm25_stemmed(_docs(spark, d), "text", "works licensed by the licensing authorities, at worthless versions of hatred", StopWordsRemover.loadDefaultStopWords("english"))
    return ranking.top(_round(found, "score"), "score", "doc_id", 20)


def dense_topk(spark, d):
    rows, q = _vectors(spark, d)
    return ranking.top(_round(ranking.dense_scores(rows, q, "vec_id", "embedding"), "score"), "score", "vec_id", 20)


def nearest_examples(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") == 1, 0.95).otherwise(0.5).alias("confidence"))
    return _round(neighbours.nearest(rows, rows, 3, 0.9), "score")


def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(F.aggregate(unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 5).alias("sum_unit"))


def _two_rankings(spark, d):
    rows = corpus.orders(spark, d)
    return rows.select("topic_id", "pmid", F.col("s").alias("score")), rows.select("topic_id", "pmid", F.col("pmid").cast("double").alias("score"))


def rrf_fusion(spark, d):
    return _round(ranking.fuse(*_two_rankings(spark, d), "pmid", ["topic_id"]), "rrf", places=9)


def sentence_retrieval(spark, d):
    return ranking.sentence_hits(_docs(spark, d), F.array(*[F.lit(k) for k in KEYWORDS])).select("doc_id", "position", "hits")


def context_budget_prefix(spark, d):
    hits = ranking.sentence_hits(_docs(spark, d), F.array(*[F.lit(k) for k in KEYWORDS]), 8)
    return ranking.budget_prefix(hits, 60).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("used").alias("used"))


def section_softmax(spark, d):
    rows = table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 5))
    q = F.array(*[F.lit(x) for x in _vectors(spark, d)[1]])
    return _round(ranking.section_attention(rows, q, "embedding", ["doc"], "vec_id"), "weight", "p")


def coverage_years(spark, d):
    return coverage.year_counts(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")))


def coverage_keywords(spark, d):
    return _round(coverage.term_coverage(_docs(spark, d), TERMS), "fraction", places=9)


def saturation(spark, d):
    counts = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    w = Window.orderBy("year")  # one row for each year
    rows = counts.withColumn("total", F.sum("n").over(w)).withColumn("before", F.col("total") - F.col("n"))
    new, flag = coverage.saturation(F.col("total"), F.col("before"))
    return rows.select("year", new.alias("new"), flag.alias("saturated"))


def completeness(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year"))
    return _round(coverage.completeness(rows, 10), "cv")


def _records(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("seq"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.concat(F.lit(" HTTPS://doi.org/"), F.regexp_extract("url", "//([^/?#]*/[^?#]*)", 1)).alias("doi"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" "), F.col("page_id") % 50)).otherwise("").alias("pmid"))


def normalise_keys(spark, d):
    return dedup.keyed(_records(spark, d)).select("seq", "doi_key", "pmid_key", "title_key")


def dedup_exact_keys(spark, d):
    return dedup.exact(dedup.keyed(_records(spark, d)), "doi_key", "seq")


def dedup_records(spark, d):
    return dedup.deduplicate(_records(spark, d), "seq")


def dedup_without_titles(spark, d):
    rows = _records(spark, d).withColumn("title", F.lit(None).cast("string"))
    return dedup.deduplicate(rows, "seq", fuzzy=False)


def phrase_extraction(spark, d):
    found = tx.phrases(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|").cast("binary")).alias("digest"))


def query_text(spark, d):
    part = F.split("text", r"\.\s*")
    a, b = (F.array_join(_every(part, 2, odd), ", ") for odd in (0, 1))
    rows = table(spark, d, "benchmark").select("item_id", tx.phrases(a).alias("a"), tx.phrases(b).alias("b"))
    return rows.select("item_id", tx.boolean_query(F.col("a"), F.col("b"), F.lit("2010"), F.lit("2020")).alias("query"), tx.keyword_query(F.array_join("a", " "), F.col("b")).alias("keywords"))


def sentence_candidates(spark, d):
    s = tx.with_keyword(tx.sentences(tx.text_or_empty("text"), 15), F.array(*[F.lit(k) for k in KEYWORDS]))
    return _docs(spark, d).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


def section_split(spark, d):
    text = F.concat(F.lit("Abstract\n"), tx.text_or_empty("text"), F.when(F.col("doc_id") % 3 > 0, F.lit("\nMethods:\nas above")).otherwise(""), F.when(F.col("doc_id") % 2 > 0, F.lit("\n2. Results\nnone\nMethods\nmore")).otherwise(""))
    rows = _docs(spark, d).select("doc_id", tx.text_sections(text).alias("sections"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("labels"), tx.parse_quality(F.col("sections")).alias("quality"))


def markup_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.strip_markup(tx.text_or_empty("html")).cast("binary")).alias("digest"), tx.slug(F.col("url")).alias("slug"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.tokens(tx.text_or_empty("text"))).alias("tokens"), F.size(tx.search_tokens(tx.text_or_empty("text"))).alias("search_tokens"), tx.prompt_key(F.col("text")).alias("prompt_sha"))


def reply_verdicts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, F.lit("INCLUDE: ")).otherwise(F.lit("Exclude: ")), F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", tx.verdict(F.col("t")).alias("verdict"), tx.exclusion_reason(F.col("t"), 40).alias("reason"))


def span_verify(spark, d):
    # evidence as replies give it: word for word, in capitals, with some letters wrong, with many wrong
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 3, 8), " ").alias("said"))
    kind = F.col("turn") % 4
    span = F.when(kind == 0, F.col("said")).when(kind == 1, F.upper("said")).when(kind == 2, F.regexp_replace("said", "^(.{9}).", "$1#")).otherwise(F.regexp_replace("said", "[aeiou]", "#"))
    return screening.verify_spans(rows.withColumn("span", span), "span", "text").select("conv_id", "turn", "verified")


def merge_canonical(spark, d):
    fetched = _docs(spark, d).select(F.col("doc_id").alias("pmid"), F.col("source").alias("title"))
    return dedup.complete_with(fetched, table(spark, d, "orders").select(F.col("o_orderkey").alias("pmid")))


def missing_positives(spark, d):
    have = _docs(spark, d).select(F.col("doc_id").alias("pmid"))
    return judgments.missing_ids(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid")), have)


def topic_overlap_sets(spark, d):
    li = table(spark, d, "lineitem")
    return dedup.set_overlap(li.where("l_returnflag = 'A'").select("l_orderkey"), li.where("l_returnflag = 'R'").select("l_orderkey"))


def _decisions(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("pmid"), F.when(F.col("n_chars") < 800, "EXCLUDE").when(F.col("n_chars") < 1500, "UNCERTAIN").otherwise("INCLUDE").alias("decision"))
    return rows, table(spark, d, "labels").select(F.col("doc_id").alias("pmid"), F.col("quality").alias("rel"))


def confusion_metrics(spark, d):
    return _round(evaluator.confusion(*_decisions(spark, d)), "recall", "fnr", "wss", "coverage", "recall_low", "recall_high", places=9)


def precision_recall_f2(spark, d):
    return evaluator.accuracy(evaluator.confusion(*_decisions(spark, d)))


def audit_trail(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("model_id"), F.col("ts").alias("timestamp"))
    return report.audit_trail(rows).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def latest_decision(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("value"), F.struct("ts", "event_id").alias("at"), "event_id")
    return stores.latest(rows, "user_id", "at").select("user_id", "event_id", "event_type", "value")


def event_stage_counts(spark, d):
    return feed.stage_counts(table(spark, d, "events"), "event_type")


def prisma_counts(spark, d):
    facts = table(spark, d, "orders").select((F.col("o_orderpriority") != "5-LOW").alias("kept"), F.when(F.col("o_orderstatus") == "O", "EXCLUDE").otherwise("INCLUDE").alias("abstract_decision"), (F.year("o_orderdate") >= 1994).alias("retrieved"), F.when(F.col("o_totalprice") < 100_000, "EXCLUDE").otherwise("INCLUDE").alias("final_decision"))
    return report.flow_counts(facts)


def _judged(spark, d):
    return evaluator.judged_run(corpus.run(spark, d), corpus.qrels(spark, d))


def rank_measures(spark, d):
    return _round(evaluator.measures(_judged(spark, d)), "ap", "wss_100", "wss_95")


def decile_gain(spark, d):
    return _round(evaluator.decile_gain(_judged(spark, d)), "gain", places=9)


def loss_measures(spark, d):
    return _round(evaluator.losses(_judged(spark, d), F.col("rank") <= 500), "r", "loss_r", "loss_e", "loss_er", places=9)


def cost_measures(spark, d):
    rows = _judged(spark, d).withColumn("action", F.when(F.col("rank") <= 300, "AF").when(F.col("rank") <= 900, "NF").otherwise("NS"))
    return _round(evaluator.costs(rows), "penalty_uniform", "penalty_weighted")


def rank_window_features(spark, d):
    return _round(evaluator.rank_windows(_judged(spark, d)), "rate", places=9)


def target_window(spark, d):
    rows = landed(_judged(spark, d), "windows")
    return evaluator.target_window(evaluator.rank_windows(rows), rows.groupBy("topic_id").agg(F.sum("rel").alias("total")), 0.8)


def stopping_state(spark, d):
    state = baselines.stopping_state(evaluator.rank_windows(_judged(spark, d)))
    return state.select("topic_id", F.posexplode("state").alias("window", "rate")).withColumn("rate", F.round("rate", 9))


def _learnable(spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("pmid"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") == 1).cast("int").alias("rel"), (F.col("vec_id") % 2).alias("part"))


def active_learning(spark, d):
    return learning.autotar(_learnable(spark, d), 0.9, batch=40, growth=0.5)


def knee_learning(spark, d):
    return learning.knee_stop(_learnable(spark, d), 100, 2.0, batch=10, growth=0.5)


def target_learning(spark, d):
    return learning.target_stop(_learnable(spark, d), 10, batch=40, growth=0.5)


def estimate_learning(spark, d):
    return learning.autostop(_learnable(spark, d), 0.9, batch=40, growth=0.5)


def estimate_learning_parts(spark, d):
    return learning.autostop_collections(_learnable(spark, d), "part", recall=0.8, batch=40, growth=0.5)


def bucket_learning(spark, d):
    return learning.scal(_learnable(spark, d), 0.9, batch=40)


def _criteria(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("criterion_id"), F.col("text").alias("criterion_text"))


def criterion_retrieval(spark, d):
    found = retrieval.with_found(_docs(spark, d), _criteria(spark, d), ["doc_id"], 3).select("doc_id", F.explode("found").alias("f"))
    positions = F.aggregate("f.sentences", F.lit(0).cast("long"), lambda a, x: a + x["position"])
    return found.select("doc_id", "f.criterion_id", F.size("f.sentences").cast("long").alias("n"), positions.alias("positions"), F.round(F.array_max("f.sentences.score"), 6).alias("best"))


def criterion_judgments(spark, d):
    found = retrieval.with_found(_docs(spark, d), _criteria(spark, d), ["doc_id", "text"], 3)
    each = F.flatten(F.transform("found", lambda f: F.transform(f["sentences"], lambda x: F.struct(x["score"].alias("score"), (-f["criterion_id"]).alias("c"), (-x["position"]).alias("p")))))
    best = found.select("doc_id", "text", F.array_max(each).alias("b")).select("doc_id", "text", (-F.col("b.c")).alias("criterion_id"), (-F.col("b.p")).alias("position"), "b.score")
    rows = best.withColumn("sentence", F.get(tx.sentences("text"), F.col("position")))
    told = rows.withColumns({"satisfies": F.when(F.col("score") >= 0.2, "true").otherwise("false"), "confidence": F.round("score", 6), "span": F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("#"), F.lit(40))).otherwise(F.col("sentence"))})
    return _round(retrieval.judged(told).select("doc_id", "criterion_id", "p", "verified", "hallucinated"), "p")


def reply_failures(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("topic_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 5 != 0).alias("failed"))
    return replies.failure_runs(rows, block=64).select("topic_id", "total", "processed", "failed", "aborted", "aborted_at")


def template_checks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", tx.text_or_empty("text").alias("text"))
    stored = F.when(F.col("turn") % 3 == 0, F.sha2("text", 256)).when(F.col("turn") % 3 == 1, F.sha2(F.concat("text", F.lit(" ")), 256))
    return rows.groupBy(replies.template_status(stored, F.col("text")).alias("status")).agg(F.count("*").alias("n"))


def validate_corpus(spark, d):
    rows = landed(corpus.scored(spark, d), "scored")
    spoilt = rows.withColumns({"s": F.col("s") * 1.05, "u": F.nullif("u", F.lit(1.0)), "is_split": F.when(F.col("y") == 1, 3).otherwise(F.col("is_split"))})
    checks = [review.check(r, "scored").select(F.lit(n).alias("corpus"), "*") for n, r in (("scored", rows), ("spoilt", spoilt))]
    return checks[0].unionByName(checks[1])


def domain_keywords(spark, d):
    part = F.split("text", r"\.\s*")
    share = [F.array_join(_every(part, 4, k), "; ").alias(n) for k, n in enumerate(("population", "intervention", "comparator", "outcome"))]
    rows = table(spark, d, "benchmark").select("item_id", F.struct(*share).alias("pico"))
    return review.keywords(rows, "item_id")


def element_candidates(spark, d):
    rows = _docs(spark, d).select("doc_id", F.create_map(F.lit("METHODS"), tx.text_or_empty("text"), F.lit("OTHER"), F.lit("a patient was treated here.")).alias("s"))
    return rows.select("doc_id", *[F.size(review.candidates_for(F.col("s"), e)).alias(e) for e in tx.ELEMENT_WORDS])


def raw_scores(spark, d):
    return _round(review.raw_scores(ranking.fuse(*_two_rankings(spark, d), "pmid", ["topic_id"])).select("topic_id", "pmid", "r_lexical", "r_dense", "raw_score"), "r_lexical", "r_dense", "raw_score", places=9)


def wss_by_topic(spark, d):
    rows = corpus.orders(spark, d).withColumn("predicted", (F.col("s") > 60_000).cast("int"))
    return rows.groupBy("topic_id").agg(F.round(routing.wss_at(F.col("predicted"), F.col("y"), 0.8), 9).alias("wss"))


def label_store(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("seed_b"), (F.col("l_partkey") % 4).alias("verdict"))
    return stores.with_label(rows).groupBy("vote_label").agg(F.count("*").alias("n"))


def ranked_label_topics(spark, d):
    got = judgments.ranked_labels(corpus.run(spark, d), corpus.qrels(spark, d).where("rel = 1"), 100)
    return got.select("topic_id", F.size("pmids").alias("n"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("positives"), F.get("pmids", 0).alias("first"))


QUERIES = {f.__name__: f for f in (criterion_retrieval, criterion_judgments, reply_failures, template_checks, validate_corpus, domain_keywords, element_candidates, raw_scores, wss_by_topic, label_store, ranked_label_topics, p_satisfy_map, noisy_or_decision, screen_all, pico_penalty_decision, first_exclusion_reason, exclusion_top5, smart_flag_threshold, tier_routing, bias_overall, bm25_scores, bm25_topk, bm25_stemmed_topk, dense_topk, nearest_examples, unit_vectors, rrf_fusion, sentence_retrieval, context_budget_prefix, section_softmax, coverage_years, coverage_keywords, saturation, completeness, normalise_keys, dedup_exact_keys, dedup_records, dedup_without_titles, phrase_extraction, query_text, sentence_candidates, section_split, markup_strip, token_counts, reply_verdicts, span_verify, merge_canonical, missing_positives, topic_overlap_sets, confusion_metrics, precision_recall_f2, audit_trail, latest_decision, event_stage_counts, prisma_counts, rank_measures, decile_gain, loss_measures, cost_measures, rank_window_features, target_window, stopping_state, active_learning, knee_learning, target_learning, estimate_learning, estimate_learning_parts, bucket_learning)}

_DOT = "list_inner_product(embedding::DOUBLE[], {q}::DOUBLE[])"
_Q1 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[])"
_BM25 = f"""tk AS (SELECT doc_id, {SEARCH} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM tk) GROUP BY term), idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
qi AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf, len(list_filter({QUERY!r}, lambda q: q = term)) AS times FROM idf WHERE list_contains({QUERY!r}, term)),
tf AS (SELECT doc_id, any_value(len(t0)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t AS t0, unnest(t) AS term FROM tk) WHERE list_contains({QUERY!r}, term) GROUP BY doc_id, term),
sc AS (SELECT tk.doc_id, round(coalesce(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0), 6) AS score FROM tk LEFT JOIN (tf JOIN qi USING (term) CROSS JOIN st) USING (doc_id) GROUP BY tk.doc_id)"""
_RUN = """rk AS (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid, (o_orderstatus = 'F')::INT AS rel, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
jr AS (SELECT *, sum(rel) OVER (PARTITION BY topic_id ORDER BY rank) AS seen, count(*) OVER (PARTITION BY topic_id) AS n_docs, sum(rel) OVER (PARTITION BY topic_id) AS n_rel FROM rk)"""
_RECORDS = r"""rec AS (SELECT page_id AS seq, regexp_extract(html, '<title>([^<]*)', 1) AS title, ' HTTPS://doi.org/' || regexp_extract(url, '//([^/?#]*/[^?#]*)', 1) AS doi, CASE WHEN page_id % 4 = 0 THEN ' ' || (page_id % 50) ELSE '' END AS pmid FROM pages),
keyed AS (SELECT seq, nullif(regexp_replace(lower(trim(doi)), '^https?://(dx\.)?doi\.org/', ''), '') AS doi_key, nullif(trim(pmid), '') AS pmid_key, regexp_replace(lower(trim(title)), '\s+', ' ', 'g') AS title_key FROM rec)"""
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > {n})"
_HITS = " + ".join(f"contains(lower(s), '{k}')::INT" for k in KEYWORDS)
_W = r"greatest(1, floor(len(list_filter(string_split_regex(trim({t}), '\s+'), lambda w: w <> '')) / 0.75))::INT"
_BEST = f"""sn AS (SELECT doc_id, {_SENT.replace('{n}', '10')} AS ss FROM documents), su AS (SELECT doc_id, i - 1 AS position, ss[i] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sn)),
sh AS (SELECT *, {_HITS} AS hits FROM su), so AS (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS most FROM sh),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN most > 0 THEN -hits ELSE 0 END, position) AS r FROM so WHERE most = 0 OR hits > 0)"""

_WORDS = {e: " OR ".join(f"contains(lower(s), '{w}')" for w in ws) for e, ws in tx.ELEMENT_WORDS.items()}

_RETRIEVED = f"""sn AS (SELECT doc_id, {_SENT.replace('{n}', '10')} AS ss FROM documents), su AS (SELECT doc_id, i - 1 AS position, ss[i] AS s, len(ss) AS n FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sn)),
tt AS (SELECT doc_id, position, term, count(*) AS tf FROM (SELECT doc_id, position, unnest({SEARCH.replace('text', 's')}) AS term FROM su) GROUP BY ALL),
ak AS (SELECT item_id AS criterion_id, term, count(*) AS times FROM (SELECT item_id, unnest({SEARCH}) AS term FROM benchmark) GROUP BY ALL),
qn AS (SELECT criterion_id, sqrt(sum(times * times)) AS q FROM ak GROUP BY 1),
ow AS (SELECT doc_id, position, sum(tf) AS dl, sqrt(sum(tf * tf)) AS norm FROM tt GROUP BY ALL),
av AS (SELECT doc_id, any_value(n) AS n, sum(dl) / any_value(n) AS avgdl FROM ow JOIN su USING (doc_id, position) GROUP BY 1),
hd AS (SELECT doc_id, term, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tt JOIN av USING (doc_id) GROUP BY ALL),
wt AS (SELECT doc_id, term, avgdl, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY doc_id) ELSE idf END AS idf FROM hd),
mt AS (SELECT doc_id, criterion_id, position, round(sum(tf * times) / (any_value(norm) * any_value(q)), 12) AS cosine, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 12) AS lexical FROM tt JOIN ak USING (term) JOIN wt USING (doc_id, term) JOIN ow USING (doc_id, position) JOIN qn USING (criterion_id) GROUP BY ALL),
al AS (SELECT doc_id, criterion_id, position, coalesce(cosine, 0) AS cosine, coalesce(lexical, 0) AS lexical FROM (SELECT doc_id, position, item_id AS criterion_id FROM su CROSS JOIN benchmark) LEFT JOIN mt USING (doc_id, criterion_id, position)),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, criterion_id ORDER BY cosine DESC, position) AS a, row_number() OVER (PARTITION BY doc_id, criterion_id ORDER BY lexical DESC, position) AS b FROM al),
rt AS (SELECT * FROM rk WHERE a <= 3 OR b <= 3 AND lexical > 0)"""

SQL = {
    "criterion_retrieval": f"WITH {_RETRIEVED} SELECT doc_id, criterion_id, count(*) AS n, sum(position)::BIGINT AS positions, round(max(cosine), 6) AS best FROM rt GROUP BY ALL",
    "criterion_judgments": f"WITH {_RETRIEVED}, bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, criterion_id, position) AS r FROM rt) SELECT doc_id, criterion_id, round(CASE WHEN cosine >= 0.2::DOUBLE THEN round(cosine, 6) ELSE least(1 - round(cosine, 6), 0.3::DOUBLE) END * CASE WHEN doc_id % 3 = 0 THEN 0.3::DOUBLE ELSE 1 END, 6) AS p, doc_id % 3 <> 0 AS verified, doc_id % 3 = 0 AS hallucinated FROM bs WHERE r = 1",
    "reply_failures": "WITH e AS (SELECT event_type AS topic_id, event_id AS seq, user_id % 5 <> 0 AS failed FROM events), i AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY topic_id ORDER BY seq) AS island FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, island, failed ORDER BY seq) AS run FROM i), a AS (SELECT topic_id, min(seq) FILTER (failed AND run >= 10) AS aborted_at FROM r GROUP BY topic_id) SELECT topic_id, count(*) AS total, count(*) FILTER (aborted_at IS NULL OR seq <= aborted_at) AS processed, count(*) FILTER (failed AND (aborted_at IS NULL OR seq <= aborted_at)) AS failed, aborted_at IS NOT NULL AS aborted, aborted_at FROM e JOIN a USING (topic_id) GROUP BY topic_id, aborted_at",
    "template_checks": "SELECT CASE turn % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'unrecorded' END AS status, count(*) AS n FROM conversations GROUP BY 1",
    "validate_corpus": _with(SCORED, "SELECT corpus, count(*) FILTER (NOT coalesce(s BETWEEN 0 AND 1, false)) AS s, count(*) FILTER (NOT coalesce(u BETWEEN 0 AND 1, false)) AS u, count(*) FILTER (NOT coalesce(y IN (0, 1), false)) AS y, count(*) FILTER (NOT coalesce(is_split IN (0, 1, 2), false)) AS split FROM (SELECT 'scored' AS corpus, s, u, y, is_split FROM scored UNION ALL SELECT 'spoilt', s * 1.05::DOUBLE, nullif(u, 1), y, CASE WHEN y = 1 THEN 3 ELSE is_split END FROM scored) GROUP BY corpus"),
    "element_candidates": f"SELECT doc_id, {', '.join(f'least(10, len(list_filter(ss, lambda s: {c}))) AS {e}' for e, c in _WORDS.items())} FROM (SELECT doc_id, {_SENT.replace('{n}', '15')} AS ss FROM documents)",
    "raw_scores": "SELECT topic_id, pmid, round(1.0::DOUBLE / (60 + a), 9) AS r_lexical, round(1.0::DOUBLE / (60 + b), 9) AS r_dense, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 9) AS raw_score FROM (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS b FROM orders)",
    "wss_by_topic": "SELECT topic_id, round(CASE WHEN recall >= 0.8::DOUBLE THEN saved END, 9) AS wss FROM (SELECT o_orderpriority AS topic_id, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 60000) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS recall, count(*) FILTER (o_totalprice <= 60000) / count(*) - (1 - 0.8::DOUBLE) AS saved FROM orders GROUP BY 1)",
    "label_store": "SELECT CASE l_partkey % 4 WHEN 1 THEN 'Include' WHEN 0 THEN 'Exclude' ELSE 'Uncertain' END AS vote_label, count(*) AS n FROM lineitem GROUP BY 1",
    "ranked_label_topics": "SELECT o_orderpriority AS topic_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS positives, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS first FROM orders GROUP BY 1 HAVING count(*) >= 100",
    "p_satisfy_map": f"WITH {JUDGED} SELECT record_id, criterion_order, criterion_id, round(p, 6) AS p FROM j",
    "noisy_or_decision": f"WITH {JUDGED} SELECT record_id, n_criteria, round(p_include, 6) AS p_include, {DECIDE.replace('{p}', 'p_include')} AS decision, round(CASE WHEN p_include >= 0.7::DOUBLE THEN p_include WHEN p_include <= 0.25::DOUBLE THEN 1 - p_include ELSE greatest(p_include, 1 - p_include) END, 6) AS confidence FROM fused",
    "screen_all": f"WITH {JUDGED}, f AS (SELECT l_orderkey AS record_id, count(*) AS n_criteria, round(least(greatest(1 - product(1 - p), 0), 1), 12) AS p_include FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN l_quantity / 60 ELSE least(1 - l_quantity / 60, 0.3::DOUBLE) END AS p FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1), h AS (SELECT o_orderkey AS record_id, coalesce(n_criteria, 0) AS n_criteria, coalesce(p_include, 0.5) AS q FROM orders LEFT JOIN f ON f.record_id = o_orderkey) SELECT record_id, n_criteria, round(q, 6) AS p_include, {DECIDE.replace('{p}', 'q')} AS decision, round(CASE WHEN q >= 0.7::DOUBLE THEN q WHEN q <= 0.25::DOUBLE THEN 1 - q ELSE greatest(q, 1 - q) END, 6) AS confidence FROM h",
    "pico_penalty_decision": f"WITH {JUDGED}, g AS (SELECT record_id, least(greatest(CASE WHEN n_criteria > 4 THEN p_include * 0.8 ELSE p_include END, 0), 1) AS q FROM fused) SELECT record_id, round(q, 6) AS p, {DECIDE.replace('{p}', 'q')} AS decision FROM g",
    "first_exclusion_reason": f"WITH {JUDGED} SELECT record_id, substr(criterion_text, 1, 80) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY criterion_order, criterion_text) AS r FROM j WHERE p <= 0.25::DOUBLE) WHERE r = 1",
    "exclusion_top5": f"WITH {JUDGED}, e AS (SELECT record_id, substr(criterion_text, 1, 80) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY criterion_order, criterion_text) AS r FROM j WHERE p <= 0.25::DOUBLE) WHERE r = 1) SELECT reason, count(*) AS n FROM e GROUP BY reason ORDER BY n DESC, reason LIMIT 5",
    "smart_flag_threshold": f"WITH {JUDGED}, g AS (SELECT round(p_include, 6) AS p, {DECIDE.replace('{p}', 'p_include')} AS decision FROM fused), q AS (SELECT quantile_cont(p, [0.75, 0.85, 0.9, 0.95]) AS q FROM g), c AS (SELECT any_value(q) AS q, count(*) FILTER (p >= q[1]) AS a, count(*) FILTER (p >= q[2]) AS b, count(*) FILTER (p >= q[3]) AS c FROM g, q), t AS (SELECT CASE WHEN a <= 400 THEN q[1] WHEN b <= 250 THEN q[2] WHEN c <= 150 THEN q[3] ELSE q[4] END AS t FROM c) SELECT decision, CASE WHEN decision = 'UNCERTAIN' OR p >= t THEN 'UNCERTAIN' ELSE 'EXCLUDE' END AS final, count(*) AS n FROM g, t GROUP BY ALL",
    "tier_routing": f"SELECT doc_id, tokens, CASE WHEN tokens < 3000 THEN 'direct' WHEN tokens <= 12000 THEN 'hierarchical' ELSE 'retrieval' END AS tier FROM (SELECT doc_id, {_W.replace('{t}', 'text')} AS tokens FROM documents)",
    "bias_overall": "SELECT l_orderkey, ['low', 'some_concerns', 'high'][max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE 1 END) + 1] AS overall FROM lineitem GROUP BY l_orderkey",
    "bm25_scores": f"WITH {_BM25} SELECT doc_id, score FROM sc",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc ORDER BY score DESC, doc_id LIMIT 20",
    "dense_topk": f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round({_COS}, 6) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 20",
    "nearest_examples": "SELECT query_id, example_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS example_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings q, (SELECT * FROM embeddings WHERE label = 1) e) WHERE r <= 3",
    "unit_vectors": "SELECT vec_id, round(list_sum(embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS sum_unit FROM embeddings",
    "rrf_fusion": "SELECT topic_id, pmid, a AS rank_lexical, b AS rank_dense, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 9) AS rrf, 1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b) >= 0.01::DOUBLE AS kept FROM (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS b FROM orders)",
    "sentence_retrieval": f"WITH {_BEST} SELECT doc_id, position, hits FROM pk WHERE r <= 5",
    "context_budget_prefix": f"WITH {_BEST}, bu AS (SELECT doc_id, sum({_W.replace('{t}', 's')}) OVER (PARTITION BY doc_id ORDER BY position) AS used FROM pk WHERE r <= 8) SELECT doc_id, count(*) AS n, max(used)::BIGINT AS used FROM bu WHERE used <= 60 GROUP BY doc_id",
    "section_softmax": f"WITH z AS (SELECT vec_id, vec_id // 5 AS doc, {_DOT.replace('{q}', _Q1)} / sqrt(len(embedding)) AS z FROM embeddings), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc)) AS e FROM z), w AS (SELECT *, e / sum(e) OVER (PARTITION BY doc) AS w FROM e) SELECT doc, arg_max(vec_id, w) AS section, round(max(w), 6) AS weight, round((max(w) + 0.5) / 2, 6) AS p FROM w GROUP BY doc",
    "coverage_years": "SELECT year, n, n < avg(n) OVER () - 2 * stddev_pop(n) OVER () AS flagged FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1)",
    "coverage_keywords": "SELECT term, n_docs, round(n_docs / total, 9) AS fraction, n_docs / total >= 0.05 AS covered FROM (SELECT term, count(*) FILTER (contains(lower(coalesce(text, '')), term)) AS n_docs, count(*) AS total FROM documents CROSS JOIN (SELECT unnest(" + repr(TERMS) + ") AS term) GROUP BY term)",
    "saturation": "SELECT year, n AS new, CASE WHEN total > n THEN n / total < 0.05 END AS saturated FROM (SELECT year, n, sum(n) OVER (ORDER BY year)::BIGINT AS total FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1))",
    "completeness": "SELECT count(DISTINCT o_orderpriority) / 10 AS db_coverage, count(*) AS n_records, any_value(n_years) AS n_years, round(any_value(cv), 6) AS cv, any_value(cv) < 0.5 AS saturated FROM orders, (SELECT count(*) AS n_years, stddev_pop(n) / avg(n) AS cv FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate)))",
    "normalise_keys": f"WITH {_RECORDS} SELECT * FROM keyed",
    "dedup_exact_keys": f"WITH {_RECORDS} SELECT seq, CASE WHEN doi_key IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY doi_key) END AS kept FROM keyed",
    "token_counts": f"SELECT doc_id, len({TOKENS}) AS tokens, len({SEARCH}) AS search_tokens, sha256(text) AS prompt_sha FROM documents",
    "markup_strip": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS digest, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS slug FROM pages",
    "sentence_candidates": f"SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, list_filter({_SENT.replace('{n}', '15')}, lambda s: {_HITS} > 0)[1:10] AS c FROM documents)",
    "reply_verdicts": r"SELECT conv_id, turn, CASE WHEN contains(upper(t), 'INCLUDE') AND NOT contains(upper(t), 'EXCLUDE') THEN 'INCLUDE' ELSE 'EXCLUDE' END AS verdict, substr(trim(regexp_extract(t, '(?is)EXCLUDE[:\s]+(.+)', 1)), 1, 40) AS reason FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'INCLUDE: ' ELSE 'Exclude: ' END || text AS t FROM conversations)",
    "merge_canonical": "SELECT doc_id AS pmid, source AS title FROM documents UNION ALL SELECT DISTINCT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)",
    "missing_positives": "SELECT DISTINCT o_orderkey AS pmid FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT doc_id FROM documents)",
    "topic_overlap_sets": "WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT *, n_only_a = 0 AND n_only_b = 0 AS equal FROM (SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_only_b)",
    "confusion_metrics": "WITH c AS (SELECT count(*) AS n_total, count(quality) AS n_judged, count(*) FILTER (quality = 1 AND n_chars >= 800) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 800) AS fp, count(*) FILTER (quality = 1 AND n_chars < 800) AS fn, count(*) FILTER (quality = 0 AND n_chars < 800) AS tn FROM documents LEFT JOIN labels USING (doc_id)), w AS (SELECT *, tp / (tp + fn) AS x, (tp + fn)::DOUBLE AS n FROM c) SELECT n_total, n_judged, tp, fp, fn, tn, round(x, 9) AS recall, round(1 - x, 9) AS fnr, round((tn + fn) / n_total - 0.05, 9) AS wss, round(n_judged / n_total, 9) AS coverage, round((x + 3.8416 / (2 * n) - 1.96 * sqrt(x * (1 - x) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS recall_low, round((x + 3.8416 / (2 * n) + 1.96 * sqrt(x * (1 - x) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS recall_high FROM w",
    "precision_recall_f2": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars >= 800) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 800) AS fp, count(*) FILTER (quality = 1 AND n_chars < 800) AS fn FROM documents LEFT JOIN labels USING (doc_id)), p AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) SELECT round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(2 * p * r / (p + r), 4) AS f1, round_even(5 * p * r / (4 * p + r), 4) AS f2 FROM p",
    "audit_trail": "SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS models, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY event_type",
    "latest_decision": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "event_stage_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "prisma_counts": "WITH f AS (SELECT o_orderpriority <> '5-LOW' AS k, o_orderstatus <> 'O' AS a, year(o_orderdate) >= 1994 AS g, o_totalprice >= 100000 AS i FROM orders) SELECT count(*) AS identified, count(*) FILTER (NOT k) AS duplicates, count(*) FILTER (k) AS screened, count(*) FILTER (k AND NOT a) AS abstract_excluded, count(*) FILTER (k AND a) AS sought, count(*) FILTER (k AND a AND NOT g) AS not_retrieved, count(*) FILTER (k AND a AND g) AS assessed, count(*) FILTER (k AND a AND g AND NOT i) AS fulltext_excluded, count(*) FILTER (k AND a AND g AND i) AS included FROM f",
    "rank_measures": f"WITH {_RUN} SELECT topic_id, n_docs, n_rel, ap, last_rel, at_95, area, round((n_docs - last_rel) / n_docs, 6) AS wss_100, round((n_docs - at_95) / n_docs - 0.05, 6) AS wss_95 FROM (SELECT topic_id, any_value(n_docs) AS n_docs, any_value(n_rel)::BIGINT AS n_rel, round(sum(CASE WHEN rel = 1 THEN seen / rank END) / any_value(n_rel), 6) AS ap, max(CASE WHEN rel = 1 THEN rank END) AS last_rel, min(CASE WHEN seen >= round_even(n_rel * 0.95, 0) THEN rank END) AS at_95, round_even(sum(seen - rel / 2) / (any_value(n_rel) * any_value(n_docs) - any_value(n_rel) * any_value(n_rel) / 2), 3) AS area FROM jr GROUP BY topic_id)",
    "decile_gain": f"WITH {_RUN} SELECT topic_id, (rank // (n_docs // 10))::INT AS decile, round(seen / n_rel, 9) AS gain FROM jr WHERE rank % (n_docs // 10) = 0 AND rank // (n_docs // 10) <= 10",
    "loss_measures": f"WITH {_RUN}, s AS (SELECT topic_id, any_value(n_docs) AS n, any_value(n_rel) AS rels, count(*) FILTER (rank <= 500) AS shown, count(*) FILTER (rank <= 500 AND rel = 1) AS found FROM jr GROUP BY topic_id), x AS (SELECT topic_id, found / rels AS r, (100 / n) ** 2 * (shown / (rels + 100)) ** 2 AS e FROM s) SELECT topic_id, round(r, 9) AS r, round((1 - r) ** 2, 9) AS loss_r, round(e, 9) AS loss_e, round((1 - r) ** 2 + e, 9) AS loss_er FROM x",
    "cost_measures": f"WITH {_RUN}, a AS (SELECT *, sum((rank > 900 AND rel = 1)::INT) OVER (PARTITION BY topic_id ORDER BY rank) AS k FROM jr) SELECT topic_id, sum(CASE WHEN rank <= 300 THEN 3 WHEN rank <= 900 THEN 1 ELSE 0 END)::BIGINT AS cost, round(count(*) FILTER (rank > 900 AND rel = 1) / any_value(n_rel) * any_value(n_docs), 6) AS penalty_uniform, round(coalesce(sum(CASE WHEN rank > 900 AND rel = 1 THEN 2.0::DOUBLE ** (-k) END), 0) * any_value(n_docs), 6) AS penalty_weighted FROM a GROUP BY topic_id",
    "rank_window_features": f"WITH {_RUN} SELECT topic_id, w::INT AS window, count(*) AS n, sum(rel)::BIGINT AS n_rel, round(avg(rel), 9) AS rate FROM (SELECT *, (rank - 1) // greatest(n_docs // 100, 1) AS w FROM jr) WHERE w < 100 GROUP BY topic_id, w",
    "stopping_state": f"WITH {_RUN}, f AS (SELECT topic_id, w, avg(rel) AS rate FROM (SELECT *, (rank - 1) // greatest(n_docs // 100, 1) AS w FROM jr) WHERE w < 100 GROUP BY topic_id, w) SELECT t.topic_id, x.i::INT AS window, round(coalesce(rate, -1), 9) AS rate FROM (SELECT DISTINCT topic_id FROM f) t CROSS JOIN range(100) x(i) LEFT JOIN f ON f.topic_id = t.topic_id AND f.w = x.i",
    "target_window": f"WITH {_RUN}, f AS (SELECT topic_id, w, sum(rel) AS r, any_value(n_rel) AS t FROM (SELECT *, (rank - 1) // greatest(n_docs // 100, 1) AS w FROM jr) WHERE w < 100 GROUP BY topic_id, w), c AS (SELECT *, sum(r) OVER (PARTITION BY topic_id ORDER BY w) AS c FROM f) SELECT topic_id, min(w)::INT AS window FROM c WHERE c >= 0.8::DOUBLE * t GROUP BY topic_id",
}
