"""Queries of the sources, stores and single-record operators, with their SQL.

Text formats are written from the driver's tables to the shared folder and read back through their readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import certify, ranking, report, review, routing, screening, votes
from ..session import scratch, spread, table
from ..sources import judgments, stores
from . import corpus, screening_run
from .screening_queries import GRID, K, K_TAU, SCORED, _with


def _lines(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def _qrel_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two lines for each order, the later one with the final label, and a comment and a blank line between."""
    o = table(spark, d, "orders")
    head = F.concat_ws(" ", "o_orderstatus", F.lit("0"), "o_orderkey")
    rel = (F.col("o_totalprice") > 150_000).cast("int")
    return o.select(F.explode(F.array(F.concat_ws(" ", head, 1 - rel), F.lit("# comment"), F.lit(""), F.concat_ws("  ", head, rel))).alias("value"))


def qrels_strict(spark, d):
    rows = judgments.strict_qrels(spark, _lines(_qrel_lines(spark, d), "qrels"))
    return rows.groupBy("topic_id", "iteration").agg(F.count("*").alias("n"), F.sum("rel").alias("positives"), F.count_distinct("pmid").alias("pmids"))


def qrels_topic(spark, d):
    return judgments.topic_qrels(spark, _lines(_qrel_lines(spark, d), "qrels"), "F")


def qrels_lenient(spark, d):
    o = table(spark, d, "orders")
    lines = o.select(F.concat_ws("\t", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, "Q0"), "o_orderkey", F.when(F.col("o_totalprice") > 150_000, "1").when(F.col("o_totalprice") > 100_000, "2").otherwise("0")).alias("value"))
    return judgments.lenient_qrels(spark, _lines(lines.select(F.replace("value", F.lit(" "), F.lit("_")).alias("value")), "qrels"))


def topic_list(spark, d):
    return judgments.topic_ids(spark, _lines(_qrel_lines(spark, d).where("value not like '#%'"), "qrels"))


def topic_columns(spark, d):
    o = table(spark, d, "orders")
    pids = _lines(o.select(F.concat_ws(" ", F.substring("o_orderpriority", 1, 1), "o_orderkey").alias("value")), "pids")
    titles = _lines(o.select("o_orderpriority").distinct().select(F.concat_ws(" ", F.substring("o_orderpriority", 1, 1), F.concat(F.lit("priority "), "o_orderpriority")).alias("value")), "titles")
    return judgments.two_column_topics(spark, pids, titles).select("topic_id", "title", F.size("pmids").alias("n"), F.aggregate("pmids", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("sum_pmids"))


def topic_blocks(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # one file for each region: a topic
    per = n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", F.concat(F.lit(" "), "n_nationkey"), F.concat(F.lit("x"), "n_nationkey")))), "\n").alias("ids"))
    path = scratch(spark, "topics")
    per.select("r_name", F.concat(F.lit("Title: About "), "r_name", F.lit("\n\nQuery: ("), "r_name", F.lit(")\n  OR\tx\n\nPids:\n"), "ids", F.lit("\n")).alias("value")).write.partitionBy("r_name").text(path)
    got = judgments.topic_file(spark, path)
    return got.select("title", "query", F.size("pmids").alias("n"), F.aggregate("pmids", F.lit(0), lambda a, x: a + x.cast("int")).alias("sum_pmids"))


def canonical_ids(spark, d):
    path = scratch(spark, "canonical") + ".parquet"
    table(spark, d, "documents").select(F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("pmid"), "source").write.parquet(path)
    return judgments.canonical_pmids(spark, path)


def run_file(spark, d):
    path = scratch(spark, "run")
    rows = corpus.run(spark, d).select(F.substring("topic_id", 1, 1).alias("topic_id"), "pmid", "rank", (F.col("rank") <= 100).alias("assessed"))
    judgments.write_run(rows, path)
    return judgments.read_run(spark, path).groupBy("topic_id", "action").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.min("score").alias("lowest"), F.count_distinct("pmid").alias("pmids"))


def medline_fields(spark, d):
    i = F.col("p_partkey").cast("string")
    doi = F.array(F.concat(F.lit("S"), i, F.lit(" [pii]")), F.concat(F.lit("10.1/"), i, F.lit(" [doi]")))
    none = F.array().cast("array<string>")
    rows = table(spark, d, "part").select(i.alias("pmid"), F.when(F.col("p_size") > 5, F.concat(F.lit(" "), "p_name")).alias("ti"), F.col("p_type").alias("ab"), F.col("p_brand").alias("jt"), F.when(F.col("p_size") > 20, F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" Mar"))).otherwise("Spring 2004").alias("dp"),
                                          F.when(F.col("p_partkey") % 2 == 0, doi).otherwise(none).alias("aid"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("10.2/"), i, F.lit(" [doi]")))).otherwise(none).alias("lid"), F.array(F.col("p_brand")).alias("au"))
    return judgments.medline_records(rows).select("external_id", "title", "journal", "year", "doi")


def article_xml(spark, d):
    body = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), F.when(F.col("p_size") > 5, F.concat(F.lit("<PMID>"), "p_partkey", F.lit("</PMID>"))).otherwise(""), F.lit("</MedlineCitation><ArticleTitle>On  <i>"), "p_name", F.lit("</i></ArticleTitle><Abstract><AbstractText>"), "p_type", F.lit("</AbstractText><AbstractText>"), "p_brand", F.lit("</AbstractText></Abstract><MeshHeading><DescriptorName>"), "p_brand", F.lit("</DescriptorName></MeshHeading></PubmedArticle>"))
    # parsing costs more than the rows: a compact file would be parsed by one task
    rows = spread(table(spark, d, "part"), "p_partkey")
    return judgments.article_records(rows.select(body.alias("xml"))).select("pmid", "title", "abstract", F.get("mesh", 0).alias("mesh"))


def _scholar(spark, d):
    i = F.col("s_suppkey").cast("string")
    item = F.struct(i.alias("paperId"), F.when(F.col("s_nationkey") > 3, F.col("s_name")).alias("title"), F.lit("v").alias("venue"), (F.col("s_nationkey") + 1990).alias("year"), F.array(F.struct(F.col("s_name").alias("name"))).alias("authors"),
                    F.when(F.col("s_nationkey") % 2 == 0, F.struct(F.concat(F.lit("http://x/"), i).alias("url"))).alias("openAccessPdf"), F.struct(F.concat(F.lit("10.3/"), i).alias("DOI"), i.alias("PubMed")).alias("externalIds"))
    return judgments.scholar_records(table(spark, d, "supplier").select(F.to_json(item).alias("item")))


def scholar_items(spark, d):
    return _scholar(spark, d).select("external_id", "title", "year", "doi", "pmid", F.size("authors").alias("n_authors"))


def source_union(spark, d):
    p = table(spark, d, "part").select(F.lit("pubmed").alias("source_database"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("pmid"))
    return judgments.union_sources([p, _scholar(spark, d)]).groupBy("source_database").agg(F.count("*").alias("n"), F.count("doi").alias("with_doi"), F.count("pmid").alias("with_pmid"))


def with_text_only(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise(" ").alias("title"), F.col("text").alias("abstract"))
    return judgments.with_text(rows).select("doc_id", "title")


def protocol_criteria(spark, d):
    c = F.struct(F.when(F.col("p_size") > 25, F.concat(F.lit("c"), "p_partkey")).alias("criterion_id"), F.col("p_name").alias("text"), F.when(F.col("p_size") > 30, "desirable").when(F.col("p_size") > 10, "exotic").alias("type"), F.lit(None).cast("string").alias("pico_element"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(stores.criteria(F.array(c))).alias("c"))
    return rows.select("p_partkey", "c.criterion_id", "c.type")


def stage_decisions(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("paper"), F.col("ts").alias("timestamp"), "event_id")
    return stores.decisions_of(rows, stage="click").select("event_id", "paper")


def decisions_json(spark, d):
    return stores.as_json(table(spark, d, "events").select("event_id", "event_type", "user_id"))


def artefact_versions(spark, d):
    root = scratch(spark, "artefacts")
    n = table(spark, d, "nation")
    for version, rows in (("v1", n.where("n_regionkey = 1")), ("v2", n)):
        stores.put_artefact(rows, root, "topics", version)
    return stores.versions(spark, root, "topics").join(F.broadcast(stores.get_artefact(spark, root, "topics", "v2").agg(F.count("*").alias("n"))))


def flat_round_trip(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("authors"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).otherwise(float("nan")).alias("year"))
    back = judgments.from_flat(judgments.flat_candidates(rows))
    return back.select("p_partkey", F.array_join("authors", "|").alias("authors"), "year")


def parsed_votes(spark, d):
    said = F.when(F.col("l_returnflag") == "A", '{"satisfies": true}').when(F.col("l_returnflag") == "R", '```json\n{"satisfies": "False"}\n```').otherwise("no idea")
    rows = table(spark, d, "lineitem").select(votes.parse_vote(said).alias("vote")).withColumn("code", votes.vote_code(F.col("vote")))
    return rows.withColumn("back", votes.vote_of_code(F.col("code"))).groupBy("vote", "code", "back").agg(F.count("*").alias("n"))


def template_keys(spark, d):
    pico = F.struct(F.col("p_name").alias("population"), F.col("p_type").alias("intervention"), F.lit(None).cast("string").alias("comparator"), F.col("p_brand").alias("outcome"), F.lit("RCT").alias("study_design"))
    rows = table(spark, d, "part").withColumn("pico", pico)
    filled = tx.fill_template("Judge {title}: {pico} {other}", {"title": F.col("p_name"), "pico": review.pico_text("pico")})
    return rows.select("p_partkey", tx.prompt_key(filled).alias("prompt_sha"), tx.head_key(F.col("p_brand"), F.col("p_name")).alias("head_sha"))


def extracted_fields(spark, d):
    reply = F.concat(F.lit('{"value": "'), F.when(F.col("p_size") > 40, " Not identified ").otherwise(F.col("p_name")), F.lit('", "confidence": '), (F.col("p_size") / 40).cast("string"), F.lit("}"))
    got = review.extracted_field(reply, F.upper(F.col("p_name")), F.when(F.col("p_size") > 20, F.concat(F.lit("a "), "p_name")).otherwise("none"))
    return table(spark, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.value", F.round("g.confidence", 9).alias("confidence"), "g.verified")


def query_pairs(spark, d):
    plain = F.concat(F.lit('{"pubmed_query": "'), "p_name", F.lit('", "s2_query": "'), "p_type", F.lit('"}'))
    reply = F.when(F.col("p_size") > 30, plain).when(F.col("p_size") > 20, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).when(F.col("p_size") > 10, F.concat(F.lit("so "), F.substring(plain, 2, 200), F.lit(" trailing"))).otherwise('{"pubmed_query": "x"}')
    rows = table(spark, d, "part").select("p_partkey", F.lit("old").alias("pubmed_query_override"), F.lit(None).cast("string").alias("s2_query_override"), review.query_pair(reply).alias("pair"))
    return review.refined(rows, F.col("pair")).select("p_partkey", "pubmed_query_override", "s2_query_override")


def refine_prompts(spark, d):
    terms = F.create_map(F.col("p_name"), F.col("p_size") > 20, F.col("p_type"), F.lit(False))
    return table(spark, d, "part").select("p_partkey", review.refine_prompt(F.col("p_brand"), F.array(F.lit("few"), F.lit("old")), terms).alias("prompt"))


def alignment(spark, d):
    rows = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in rows.orderBy("vec_id").limit(1).first()["embedding"]])
    c, flags = screening.alignment_flags(F.col("embedding"), q)
    return rows.select("vec_id", F.round(c, 6).alias("alignment"), (F.size(flags) > 0).alias("flagged"))


def refine_modes(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("gaps"))
    return rows.select("o_custkey", screening.refine_mode(F.col("n") * 2, F.col("gaps") > 0).alias("small"), screening.refine_mode(F.col("n") * 1000, F.col("gaps") > 0).alias("large"))


def bias_tools(spark, d):
    design = F.when(F.col("p_size") > 30, F.concat(F.lit("Randomised "), "p_type")).when(F.col("p_size") > 15, "an RCT").when(F.col("p_size") > 5, F.col("p_type"))
    return table(spark, d, "part").groupBy(screening.bias_tool(design).alias("tool")).agg(F.count("*").alias("n"))


def retrieval_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("priority"), (F.col("l_returnflag") != "N").alias("success"), F.concat(F.lit("source "), "l_linenumber").alias("source"), F.concat(F.lit("http://x/"), "l_partkey").alias("url"))
    return ranking.first_success(rows, "l_orderkey")


def best_locations(spark, d):
    places = F.array(F.struct(F.lit(None).cast("string").alias("url")), F.struct(F.when(F.col("p_size") > 20, F.concat(F.lit("http://y/"), "p_partkey")).alias("url")))
    return table(spark, d, "part").select("p_partkey", ranking.best_url(F.when(F.col("p_size") > 40, F.concat(F.lit("http://x/"), "p_partkey")), places).alias("url"))


def human_bypass(spark, d):
    source = F.when(F.col("n_chars") < 800, "unavailable").when(F.col("n_chars") < 1500, "fetched")
    return table(spark, d, "documents").groupBy(routing.needs_human(source).alias("human")).agg(F.count("*").alias("n"))


def unknown_ids(spark, d):
    """Routes of ids of which some have no scores."""
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pmid")).distinct()
    return routing.routed_ids(ids, corpus.scored(spark, d), 0.3, 0.7, 0.6).groupBy("route", "decision").agg(F.count("*").alias("n"))


def paper_links(spark, d):
    return report.papers(table(spark, d, "documents").select(F.col("doc_id").alias("pmid"), F.col("source").alias("title")))


def certificate_store(spark, d):
    root = scratch(spark, "certificate")
    points = certify.breakpoints(corpus.scored(spark, d).where("is_split = 1"), K)
    grid = certify.theta_grid(points, K_TAU).select("topic_id", "theta_idx", "lambda_lo")
    stores.save_certificate(grid, grid.groupBy("topic_id").agg(F.count("*").alias("n_grid")), root)
    saved, summary = stores.load_certificate(spark, root)
    rest = stores.unfinished(saved, saved.where("lambda_lo > 0.5")).groupBy("topic_id").agg(F.count("*").alias("n_left"))
    return summary.join(rest, "topic_id").select("topic_id", F.col("n_grid").cast("long").alias("n_grid"), "n_left")


def event_log(spark, d):
    path = scratch(spark, "events")
    rows = table(spark, d, "events").select("event_type", "event_id", "ts")
    stores.emit(rows.where("event_id % 2 = 0"), path)
    stores.emit(rows.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_type string, event_id long").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def preflight_checks(spark, d):
    return screening_run.preflight(corpus.scored(spark, d))


def flow_compliance(spark, d):
    rows = table(spark, d, "orders")
    counts = rows.agg(F.count("*").alias("identified"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("screened"), *[F.lit(None).cast("long").alias(c) for c in report.FLOW if c not in ("identified", "screened", "sought", "assessed", "included")], F.count("*").alias("sought"), F.count_if(F.col("o_orderstatus") == "F").alias("assessed"), F.count_if(F.col("o_orderstatus") == "P").alias("included"))
    return report.compliance(counts).withColumn("score", F.round("score", 9))


def corpus_files(spark, d):
    path = scratch(spark, "corpus")
    rows = table(spark, d, "documents").select("lang", F.col("doc_id").alias("pmid"), F.col("source").alias("title"), F.lit(None).cast("string").alias("abstract"), (F.col("n_chars") > 1000).cast("int").alias("y_abstract"), F.lit(1).alias("is_calib"))
    judgments.write_corpus(rows.withColumnRenamed("lang", "topic_id"), path)
    return spark.read.parquet(path).groupBy(F.col("topic_id").cast("string").alias("topic_id")).agg(F.count("*").alias("n"), F.sum("y_abstract").alias("positives"), F.count("abstract").alias("abstracts"))


QUERIES = {f.__name__: f for f in (qrels_strict, qrels_topic, qrels_lenient, topic_list, topic_columns, topic_blocks, canonical_ids, run_file, medline_fields, article_xml, scholar_items, source_union, with_text_only, protocol_criteria, stage_decisions, decisions_json, artefact_versions, flat_round_trip, parsed_votes, template_keys, extracted_fields, query_pairs, refine_prompts, alignment, refine_modes, bias_tools, retrieval_first, best_locations, human_bypass, unknown_ids, paper_links, certificate_store, event_log, preflight_checks, flow_compliance, corpus_files)}

_REL = "(o_totalprice > 150000)::INT"
SQL = {
    "qrels_strict": "SELECT o_orderstatus AS topic_id, '0' AS iteration, 2 * count(*) AS n, count(*) AS positives, count(*) AS pmids FROM orders GROUP BY o_orderstatus",
    "qrels_topic": f"SELECT o_orderkey::VARCHAR AS pmid, {_REL} AS rel FROM orders WHERE o_orderstatus = 'F'",
    "qrels_lenient": f"SELECT replace(o_orderpriority, ' ', '_') AS topic_id, o_orderkey::VARCHAR AS pmid, {_REL} AS rel FROM orders WHERE o_orderkey % 3 > 0",
    "topic_list": "SELECT DISTINCT o_orderstatus AS topic_id FROM orders",
    "topic_columns": "SELECT substr(o_orderpriority, 1, 1) AS topic_id, 'priority ' || o_orderpriority AS title, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_pmids FROM orders GROUP BY o_orderpriority",
    "topic_blocks": "SELECT 'About ' || r_name AS title, '(' || r_name || ') OR x' AS query, count(*) AS n, sum(n_nationkey)::BIGINT AS sum_pmids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "canonical_ids": "SELECT doc_id::VARCHAR AS pmid FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL",
    "run_file": "SELECT substr(topic_id, 1, 1) AS topic_id, CASE WHEN rank <= 100 THEN 'AF' ELSE 'NF' END AS action, count(*) AS n, max(rank)::INT AS last, (1 - max(rank))::DOUBLE AS lowest, count(*) AS pmids FROM (SELECT o_orderpriority AS topic_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) GROUP BY 1, 2",
    "medline_fields": "SELECT p_partkey::VARCHAR AS external_id, p_name AS title, p_brand AS journal, CASE WHEN p_size > 20 THEN 2000 + p_size END AS year, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey WHEN p_partkey % 3 = 0 THEN '10.2/' || p_partkey END AS doi FROM part WHERE p_size > 5",
    "article_xml": "SELECT p_partkey::VARCHAR AS pmid, 'On ' || p_name AS title, p_type || ' ' || p_brand AS abstract, p_brand AS mesh FROM part WHERE p_size > 5",
    "scholar_items": "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'http://x/' || s_suppkey ELSE s_suppkey::VARCHAR END AS external_id, s_name AS title, s_nationkey + 1990 AS year, '10.3/' || s_suppkey AS doi, s_suppkey::VARCHAR AS pmid, 1 AS n_authors FROM supplier WHERE s_nationkey > 3",
    "source_union": "SELECT 'pubmed' AS source_database, count(*) AS n, 0::BIGINT AS with_doi, count(*) AS with_pmid FROM part UNION ALL SELECT 'semantic_scholar', count(*), count(*), count(*) FROM supplier WHERE s_nationkey > 3",
    "with_text_only": "SELECT doc_id, source AS title FROM documents WHERE lang = 'en' AND length(trim(source)) > 0 AND length(trim(text)) > 0",
    "protocol_criteria": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'c' || p_partkey ELSE sha256(p_name) END AS criterion_id, CASE WHEN p_size > 30 THEN 'DESIRABLE' ELSE 'MANDATORY' END AS type FROM part",
    "stage_decisions": "SELECT event_id, user_id AS paper FROM events WHERE event_type = 'click'",
    "decisions_json": """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""",
    "artefact_versions": "SELECT v AS version, n FROM (SELECT unnest(['v1', 'v2']) AS v), (SELECT count(*) AS n FROM nation)",
    "flat_round_trip": "SELECT p_partkey, p_brand || '|' || p_type AS authors, CASE WHEN p_size > 10 THEN p_size END AS year FROM part",
    "parsed_votes": "SELECT vote, CASE vote WHEN 'Include' THEN 1 WHEN 'Uncertain' THEN 2 ELSE 0 END AS code, vote AS back, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'Include' WHEN 'R' THEN 'Exclude' ELSE 'Uncertain' END AS vote FROM lineitem) GROUP BY vote",
    "template_keys": "SELECT p_partkey, sha256('Judge ' || p_name || ': Population: ' || p_name || chr(10) || 'Intervention: ' || p_type || chr(10) || 'Comparator: ' || chr(10) || 'Outcome: ' || p_brand || chr(10) || 'Study design: RCT {other}') AS prompt_sha, sha256(p_brand || ':' || p_name) AS head_sha FROM part",
    "extracted_fields": "SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_name END AS value, round(least(p_size / 40, 1), 9) AS confidence, p_size > 20 AS verified FROM part",
    "query_pairs": "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name ELSE 'old' END AS pubmed_query_override, CASE WHEN p_size > 10 THEN p_type END AS s2_query_override FROM part",
    "refine_prompts": "SELECT p_partkey, 'Query: ' || p_brand || chr(10) || 'Gaps: few; old' || chr(10) || 'Uncovered: ' || CASE WHEN p_size > 20 THEN '' ELSE p_name || ', ' END || p_type AS prompt FROM part",
    "alignment": "SELECT vec_id, round(least(greatest(c, 0), 1), 6) AS alignment, least(greatest(c, 0), 1) < 0.6::DOUBLE AS flagged FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]) AS c FROM embeddings)",
    "refine_modes": "SELECT o_custkey, CASE WHEN 2 * n < 20 THEN 'RELAX' WHEN 2 * n > 5000 THEN 'NARROW' WHEN gaps > 0 THEN 'FILL_GAPS' END AS small, CASE WHEN 1000 * n < 20 THEN 'RELAX' WHEN 1000 * n > 5000 THEN 'NARROW' WHEN gaps > 0 THEN 'FILL_GAPS' END AS large FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS gaps FROM orders GROUP BY o_custkey)",
    "bias_tools": "SELECT tool, count(*) AS n FROM (SELECT CASE WHEN p_size > 15 THEN 'RoB2' ELSE 'NOS' END AS tool FROM part) GROUP BY tool",
    "retrieval_first": "SELECT l_orderkey, 'source ' || l_linenumber AS source, 'http://x/' || l_partkey AS url FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'http://x/' || l_partkey) AS r FROM lineitem WHERE l_returnflag <> 'N') WHERE r = 1",
    "best_locations": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'http://x/' || p_partkey WHEN p_size > 20 THEN 'http://y/' || p_partkey END AS url FROM part",
    "human_bypass": "SELECT coalesce(n_chars < 800, false) AS human, count(*) AS n FROM documents GROUP BY 1",
    "unknown_ids": _with(SCORED, "SELECT route, CASE WHEN route = 'auto_reject' THEN 'EXCLUDE' ELSE 'INCLUDE' END AS decision, count(*) AS n FROM (SELECT CASE WHEN s >= 0.7::DOUBLE THEN 'auto_accept' WHEN s < 0.3::DOUBLE THEN 'auto_reject' WHEN u >= 0.6::DOUBLE THEN 'llm_escalate' ELSE 'human_review' END AS route FROM (SELECT coalesce(s, 0) AS s, coalesce(u, 0) AS u FROM (SELECT DISTINCT l_partkey AS pmid FROM lineitem) LEFT JOIN scored USING (pmid))) GROUP BY route"),
    "paper_links": "SELECT doc_id AS pmid, source AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url FROM documents",
    "certificate_store": _with(GRID, "SELECT topic_id, count(*) AS n_grid, count(*) FILTER (lambda_lo <= 0.5::DOUBLE) AS n_left FROM grid GROUP BY topic_id"),
    "event_log": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type",
    "preflight_checks": _with(SCORED, "SELECT 'columns' AS check, 'PASS' AS status UNION ALL SELECT 'rows', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM scored UNION ALL SELECT 'scores', CASE WHEN max(s) > 0 THEN 'PASS' ELSE 'FAIL' END FROM scored UNION ALL SELECT 'positives', CASE WHEN count(*) FILTER (y = 1) > 0 THEN 'PASS' ELSE 'FAIL' END FROM scored"),
    "flow_compliance": "SELECT round(5 / 9::DOUBLE, 9) AS score, (count(*) FILTER (o_orderpriority <> '5-LOW') > count(*))::INT + (count(*) FILTER (o_orderpriority <> '5-LOW') < count(*))::INT + (count(*) FILTER (o_orderstatus = 'F') > count(*))::INT + (count(*) FILTER (o_orderstatus = 'F') < count(*) FILTER (o_orderstatus = 'P'))::INT AS warnings FROM orders",
    "corpus_files": "SELECT lang AS topic_id, count(*) AS n, sum((n_chars > 1000)::INT)::BIGINT AS positives, 0::BIGINT AS abstracts FROM documents GROUP BY lang",
}
