"""Queries of the certified-screening operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import inverse_normal, wilson
from ..operators import baselines, calibration, certify, routing, splits, synthetic, votes
from ..operators.report import with_mean
from ..session import landed, scratch, table
from ..sources import stores
from . import corpus, topic_runs

K, K_TAU, ALPHA, DELTA = 10, 5, 0.10, 0.07
THETA = (0.3, 0.7, 0.6)

VOTES = "votes AS (SELECT l_orderkey AS pmid, l_linenumber AS slot, CASE l_returnflag WHEN 'A' THEN 'Include' WHEN 'R' THEN 'Exclude' ELSE 'Uncertain' END AS vote FROM lineitem)"
MAJORITY = VOTES + """,
tally AS (SELECT pmid, count(*) AS n, count(*) FILTER (vote = 'Include') AS n_include, count(*) FILTER (vote = 'Exclude') AS n_exclude FROM votes GROUP BY pmid),
majority AS (SELECT *, CASE WHEN n_include > n_exclude THEN 'Include' WHEN n_exclude > n_include THEN 'Exclude' ELSE 'Uncertain' END AS majority,
  CASE WHEN n_include = n_exclude THEN 0.0::DOUBLE ELSE greatest(n_include, n_exclude) / n END AS u, (n_include > n_exclude)::INT AS y_hat FROM tally)"""
SCORED = MAJORITY + """,
raw AS (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid, o_totalprice AS price, (o_orderstatus = 'F')::INT AS y FROM orders),
sc AS (SELECT topic_id, pmid, y, rank() OVER (PARTITION BY topic_id ORDER BY price) / count(*) OVER (PARTITION BY topic_id) AS s FROM raw),
mj AS (SELECT sc.*, coalesce(m.u, s) AS u, coalesce(m.y_hat, 0) AS y_hat FROM sc LEFT JOIN majority m USING (pmid)),
sp AS (SELECT *, row_number() OVER (PARTITION BY topic_id, y ORDER BY md5('20260429:' || pmid), pmid) AS r, count(*) OVER (PARTITION BY topic_id, y) AS k FROM mj),
scored AS (SELECT topic_id, pmid, s, u, y, y_hat, CASE WHEN r <= floor(0.15::DOUBLE * k + 0.5) THEN 0 WHEN r <= floor(0.65::DOUBLE * k + 0.5) THEN 1 ELSE 2 END AS is_split FROM sp),
calib AS (SELECT * FROM scored WHERE is_split = 1)"""
_Q = ", ".join(f"{i}.0 / {K - 1}.0" for i in range(K))
GRID = SCORED + f""",
points AS (SELECT topic_id, list_sort(list_distinct(list_concat(quantile_cont(s, [{', '.join(repr(i / (K - 1)) + '::DOUBLE' for i in range(K))}]), [0.0::DOUBLE, 1.0::DOUBLE]))) AS points FROM calib GROUP BY topic_id),
pt AS (SELECT topic_id, unnest(points) AS v FROM points),
grid AS (SELECT a.topic_id, a.v AS lambda_lo, b.v AS lambda_hi, t.i / {K_TAU - 1}::DOUBLE AS tau,
  row_number() OVER (PARTITION BY a.topic_id ORDER BY a.v, b.v, t.i) - 1 AS theta_idx
  FROM pt a JOIN pt b ON a.topic_id = b.topic_id AND a.v <= b.v CROSS JOIN range({K_TAU}) t(i)),
risks AS (SELECT g.topic_id, theta_idx, any_value(lambda_lo) AS lambda_lo, any_value(lambda_hi) AS lambda_hi, any_value(tau) AS tau, count(*) FILTER (y = 1) AS m_plus,
  count(*) FILTER (y = 1 AND (s < lambda_lo OR (s < lambda_hi AND u >= tau))) AS n_miss,
  count(*) FILTER (y = 1 AND s >= lambda_lo AND s < lambda_hi AND u >= tau AND y_hat = 1) AS n_slack,
  (5.0::DOUBLE * count(*) FILTER (s >= lambda_hi) + 0.001::DOUBLE * count(*) FILTER (s >= lambda_lo AND s < lambda_hi) + 5.0::DOUBLE * count(*) FILTER (s >= lambda_lo AND s < lambda_hi AND u < tau)) / count(*) AS cost
  FROM grid g JOIN calib c USING (topic_id) GROUP BY g.topic_id, theta_idx)"""


def _p_sql(alpha: str) -> str:
    r = f"least(n_miss / m_plus, {alpha})"
    kl = f"(CASE WHEN {r} > 0 THEN {r} * ln({r} / {alpha}) ELSE 0 END + CASE WHEN {r} < 1 THEN (1 - {r}) * ln((1 - {r}) / (1 - {alpha})) ELSE 0 END)"
    cdf = f"list_sum(list_transform(range(n_miss::BIGINT + 1), lambda i: exp(lgamma(m_plus + 1.0) - lgamma(i + 1.0) - lgamma(m_plus - i + 1.0) + i * ln({alpha}) + (m_plus - i) * ln(1 - {alpha}))))"
    return f"least(exp(-m_plus * {kl}), {2.718281828459045}::DOUBLE * least(1.0, {cdf}))"


TESTED = GRID + f""",
tested AS (SELECT *, n_miss / m_plus AS r_hat, {_p_sql('0.1::DOUBLE')} AS p FROM risks)"""
HOLM = TESTED + f""",
step AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY p, theta_idx) - 1 AS i, count(*) OVER (PARTITION BY topic_id) AS m FROM tested),
holm AS (SELECT *, max((p > {DELTA}::DOUBLE / (m - i))::INT) OVER (PARTITION BY topic_id ORDER BY p, theta_idx ROWS UNBOUNDED PRECEDING) = 0 AS certified FROM step)"""
ROUTED = SCORED + """,
test AS (SELECT * FROM scored WHERE is_split = 2),
routed AS (SELECT *, CASE WHEN s >= 0.7::DOUBLE THEN 'auto_accept' WHEN s < 0.3::DOUBLE THEN 'auto_reject' WHEN u >= 0.6::DOUBLE THEN 'llm_escalate' ELSE 'human_review' END AS route FROM test),
inc AS (SELECT *, CASE route WHEN 'auto_reject' THEN 0 WHEN 'llm_escalate' THEN y_hat ELSE 1 END AS included FROM routed)"""


def _with(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


def _calib(spark: SparkSession, d: str) -> DataFrame:
    return landed(corpus.scored(spark, d).where("is_split = 1"), "calibration-rows")


def _risks(spark: SparkSession, d: str) -> DataFrame:
    rows = _calib(spark, d)
    points = certify.breakpoints(rows, K)
    return certify.grid_risks(certify.theta_grid(points, K_TAU), certify.histogram(rows, points, K_TAU))


def _tested(spark: SparkSession, d: str) -> DataFrame:
    return certify.pvalues(_risks(spark, d), F.lit(ALPHA))


def _theta(rows: DataFrame) -> DataFrame:
    lo, hi, tau = THETA
    return rows.withColumn("route", routing.route(F.col("s"), F.col("u"), F.lit(lo), F.lit(hi), F.lit(tau)))


def _rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def vote_majority(spark, d):
    return _rounded(votes.majority(corpus.votes(spark, d), ["pmid"]), "u")


def vote_include_share(spark, d):
    return _rounded(votes.include_share(corpus.votes(spark, d), ["pmid"]), "u")


def vote_complete_ensembles(spark, d):
    return _rounded(votes.majority(corpus.votes(spark, d), ["pmid"], 5), "u")


def vote_cache_stats(spark, d):
    return stores.vote_stats(corpus.votes(spark, d), "slot")


def _vote_rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("model_id"), F.col("l_linenumber").alias("seed_b"), F.col("l_orderkey").alias("pmid"), F.col("l_quantity").alias("value"), F.struct("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"))


def vote_first_wins(spark, d):
    return stores.first_votes(_vote_rows(spark, d), ["model_id", "seed_b"], "at").select("model_id", "seed_b", "pmid", "value")


def vote_topk_slots(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return stores.ensemble(rows, ["l_orderkey"], 3, "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("slot_rank").alias("slots"), F.sum("l_linenumber").alias("sum_slots"))


def purge_empty(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("value") < 10, F.lit("{}")).when(F.col("value") < 20, F.lit(" ")).when(F.col("value") < 30, F.lit(None).cast("string")).otherwise(F.col("props")).alias("response"))
    return stores.without_empty(rows).select("event_id", "response")


def dry_run_calls(spark, d):
    rows = votes.still_to_call(corpus.orders(spark, d), corpus.votes(spark, d).where("vote <> 'Uncertain'"), 3)
    return _rounded(rows, "hit_rate")


def scored_corpus(spark, d):
    return _rounded(corpus.scored(spark, d), "s", "u")


def split_counts(spark, d):
    return corpus.scored(spark, d).groupBy("topic_id", "is_split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


def calib_test_split(spark, d):
    return splits.calib_test_split(corpus.orders(spark, d), 0.5, 10_000, 42).select("topic_id", "pmid", "y", "is_calib")


def quantile_scale(spark, d):
    return _rounded(splits.quantile_scale(corpus.orders(spark, d)), "s")


def nested_subsample(spark, d):
    return splits.subsample_positives(corpus.scored(spark, d), 25).where("is_split = 1 AND y = 1").select("topic_id", "pmid")


def nmin_compliance(spark, d):
    return routing.nmin_compliance(corpus.scored(spark, d), ALPHA, DELTA)


def theta_breakpoints(spark, d):
    return certify.breakpoints(_calib(spark, d), K).select("topic_id", F.posexplode("points").alias("i", "point")).withColumn("point", F.round("point", 9))


def theta_grid(spark, d):
    return _rounded(certify.theta_grid(certify.breakpoints(_calib(spark, d), K), K_TAU).select("topic_id", "theta_idx", "lambda_lo", "lambda_hi", "tau"), "lambda_lo", "lambda_hi", "tau")


def theta_risk_histogram(spark, d):
    return _rounded(_risks(spark, d).select("topic_id", "theta_idx", "m_plus", "n_miss", "n_slack", "cost"), "cost")


def hb_pvalues(spark, d):
    return _rounded(_tested(spark, d).select("topic_id", "theta_idx", "r_hat", "p"), "r_hat", "p")


def holm_reject(spark, d):
    return certify.holm(_tested(spark, d), DELTA).select("topic_id", "theta_idx", "certified")


def _walk(order):
    return lambda spark, d: certify.walk(_tested(spark, d), DELTA, order).select("topic_id", "theta_idx", "certified")


def _walk_sql(order: str) -> str:
    return _with(TESTED, f"SELECT topic_id, theta_idx, max((p > {DELTA}::DOUBLE)::INT) OVER (PARTITION BY topic_id ORDER BY {order}, theta_idx ROWS UNBOUNDED PRECEDING) = 0 AS certified FROM tested")


def theta_argmin(spark, d):
    return _rounded(certify.cheapest(certify.holm(_tested(spark, d), DELTA)), "lambda_lo", "lambda_hi", "tau")


def certify_rule(spark, d):
    return certify.certify(_calib(spark, d), ALPHA, 0.03, DELTA, K, K_TAU)


def certify_walk(spark, d):
    return certify.certify(_calib(spark, d), ALPHA, 0.03, DELTA, K, K_TAU, order="safest")


def wsr_lcb_anchors(spark, d):
    return certify.anchor_bounds(_calib(spark, d), 0.03)


def alpha_sweep(spark, d):
    """The same tests at six risks in one job: the risk is a column of the grid."""
    rows = _risks(spark, d).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in (0.01, 0.05, 0.1, 0.15, 0.2, 0.3)])))
    tested = certify.pvalues(rows, F.col("alpha"))
    return certify.cheapest(certify.holm(tested, DELTA, ["topic_id", "alpha"]), ["topic_id", "alpha"]).select("topic_id", "alpha", "n_certified", "theta_idx")


def synthetic_corpus(spark, d):
    """The beta mixture over every order's id."""
    rows = synthetic.beta_mixture(corpus.orders(spark, d).select("topic_id", "pmid"))
    return _rounded(rows, "s", "u")


def synthetic_certificate(spark, d):
    """Certified points of the beta mixture, one topic over all orders."""
    rows = landed(synthetic.beta_mixture(corpus.orders(spark, d).select(F.lit("all").alias("topic_id"), "pmid")), "synthetic-rows")
    points = certify.breakpoints(rows, K)
    tested = certify.pvalues(certify.grid_risks(certify.theta_grid(points, K_TAU), certify.histogram(rows, points, K_TAU)), F.lit(ALPHA))
    return _rounded(certify.cheapest(certify.holm(tested, DELTA)), "lambda_lo", "lambda_hi", "tau")


def topic_fanout(spark, d):
    """The cheapest certified point of each topic, topics side by side: first their rows, then their thresholds."""
    shared, root = scratch(spark, "topic-rows"), scratch(spark, "topic-runs")
    corpus.scored(spark, d).where("is_split = 1").write.partitionBy("topic_id").parquet(shared)

    def rows(spark: SparkSession, topic: str, _: dict[str, DataFrame]) -> DataFrame:
        return spark.read.parquet(shared).where(F.col("topic_id") == topic)

    def thresholds(spark: SparkSession, topic: str, done: dict[str, DataFrame]) -> DataFrame:
        points = certify.breakpoints(done["rows"], K)
        risks = certify.grid_risks(certify.theta_grid(points, K_TAU), certify.histogram(done["rows"], points, K_TAU))
        return certify.cheapest(certify.holm(certify.pvalues(risks, F.lit(ALPHA)), DELTA))

    topics = [r.topic_id for r in spark.read.parquet(shared).select("topic_id").distinct().collect()]
    log = topic_runs.run_topics(spark, topics, [topic_runs.Phase("rows", rows, 4), topic_runs.Phase("thresholds", thresholds, 2)], root)
    if failed := log.where("status = 'failed'").first():
        raise RuntimeError(f"{failed.topic_id}: {failed.error}")
    return _rounded(topic_runs.gathered(spark, topics, "thresholds", root), "lambda_lo", "lambda_hi", "tau")


def budget_split(spark, d):
    """Certified points by how the confidence is divided: five levels of the tests in one job."""
    rows = _tested(spark, d)
    parts = [certify.cheapest(certify.holm(rows, delta)).select("topic_id", F.lit(delta).alias("delta_ltt"), "n_certified", "theta_idx") for delta in (0.05, 0.06, 0.07, 0.08, 0.09)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walk_orders(spark, d):
    rows = landed(_tested(spark, d), "walk-orders")
    out = None
    for name, seed in [("safest", 0), ("riskiest", 0), ("tau_first", 0), *[("random", i) for i in range(5)]]:
        part = certify.walk(rows, DELTA, name, seed).groupBy("topic_id").agg(F.count_if("certified").alias("n_certified")).select("topic_id", F.lit(name).alias("walk"), F.lit(seed).alias("seed"), "n_certified")
        out = part if out is None else out.unionByName(part)
    return out


def route_decisions(spark, d):
    return _theta(corpus.scored(spark, d).where("is_split = 2")).select("topic_id", "pmid", "route", routing.included().alias("included"), routing.five_way(F.col("s"), F.col("u"), F.lit(0.3), F.lit(0.7), F.lit(0.6)).alias("five_way"))


def route_summary(spark, d):
    return _evaluated(spark, d)


def _evaluated(spark, d, keys=("topic_id",)):
    out = routing.evaluate(_theta(corpus.scored(spark, d).where("is_split = 2")), list(keys), 0.9)
    return _rounded(out, "fnr", "recall", "wss", "llm_calls", "abstention", *[f"frac_{r}" for r in routing.ROUTES])


EVALUATED = ROUTED + """,
evaluated AS (SELECT topic_id, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (route = 'auto_accept') AS n_auto_accept, count(*) FILTER (route = 'auto_reject') AS n_auto_reject,
  count(*) FILTER (route = 'llm_escalate') AS n_llm_escalate, count(*) FILTER (route = 'human_review') AS n_human_review,
  coalesce(count(*) FILTER (y = 1 AND (route = 'auto_reject' OR (route = 'llm_escalate' AND y_hat = 0))) / nullif(count(*) FILTER (y = 1), 0), 0) AS fnr,
  count(*) FILTER (y = 1 AND included = 1) / nullif(count(*) FILTER (y = 1), 0) AS recall, count(*) FILTER (included = 0) / count(*) - (1 - 0.9::DOUBLE) AS saved FROM inc GROUP BY topic_id),
summary AS (SELECT topic_id, n, n_pos, n_auto_accept, n_auto_reject, n_llm_escalate, n_human_review, round(n_auto_accept / n, 9) AS frac_auto_accept, round(n_auto_reject / n, 9) AS frac_auto_reject,
  round(n_llm_escalate / n, 9) AS frac_llm_escalate, round(n_human_review / n, 9) AS frac_human_review, round(fnr, 9) AS fnr, round(recall, 9) AS recall,
  round(CASE WHEN recall >= 0.9::DOUBLE THEN saved END, 9) AS wss, round(5 * n_llm_escalate / n, 9) AS llm_calls, round(n_human_review / greatest(n_human_review + n_llm_escalate, 1), 9) AS abstention FROM evaluated)"""


def cross_topic_stats(spark, d):
    return _rounded(routing.cross_topic(_evaluated(spark, d), ["fnr", "llm_calls"]), "fnr_mean", "fnr_se", "llm_calls_mean", "llm_calls_se", places=7)


def theorem_violations(spark, d):
    return _rounded(routing.risk_violations(_evaluated(spark, d).withColumn("alpha", F.lit(0.5))), "pass_rate")


def summary_with_mean(spark, d):
    return _rounded(with_mean(_evaluated(spark, d), "topic_id", ["fnr", "recall"]), "fnr", "recall", places=7)


def slack_ratio(spark, d):
    rows = _risks(spark, d).withColumn("eta", F.col("n_slack") / F.col("m_plus"))
    return _rounded(rows.select("topic_id", "theta_idx", routing.slack_ratio(F.col("eta") / 2, F.col("eta")).alias("ratio")), "ratio")


def scrc_t_threshold(spark, d):
    return _rounded(baselines.scrc(_calib(spark, d), 0.1), "tau", "lambda_star")


def scrc_i_threshold(spark, d):
    return _rounded(baselines.scrc(_calib(spark, d), 0.1, inductive=True), "tau", "lambda_star")


def scrc_sweep(spark, d):
    rows = landed(corpus.scored(spark, d), "scrc-rows")
    test, out = rows.where("is_split = 2"), None
    for recall in (0.8, 0.9, 0.95):
        for variant in (False, True):
            fitted = baselines.scrc(rows.where("is_split = 1"), 1 - recall, inductive=variant)
            part = baselines.scrc_result(baselines.scrc_accept(test, fitted), "scrc-i" if variant else "scrc-t", recall)
            out = part if out is None else out.unionByName(part)
    return _rounded(out, "recall_achieved", "wss")


def reliability_bins(spark, d):
    return _rounded(splits.reliability_bins(corpus.scored(spark, d)), "mean_score", "positive_rate", places=7)


def calibrated_scores(spark, d):
    return calibration.calibrate(corpus.scored(spark, d))[0].select("topic_id", "pmid", "s_raw", "s")


def wilson_ci(spark, d):
    rows = corpus.scored(spark, d).groupBy("topic_id").agg(F.count_if((F.col("y") == 1) & (F.col("y_hat") == 1)).alias("k"), F.count_if(F.col("y") == 1).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return _rounded(rows.select("topic_id", "k", "n", low.alias("low"), high.alias("high")), "low", "high")


def _sampled(spark, d, weight):
    w = Window.partitionBy("topic_id")
    rows = corpus.run(spark, d).join(corpus.qrels(spark, d), ["topic_id", "pmid"]).withColumn("n_docs", F.count("*").over(w))
    return baselines.sampled(baselines.probabilities(rows, weight), 300, 5)


def ht_ap_prior_estimate(spark, d):
    return _rounded(baselines.horvitz_thompson(_sampled(spark, d, baselines.ap_prior), 300), "total", "variance", places=3)


def hh_estimate(spark, d):
    return _rounded(baselines.hansen_hurwitz(_sampled(spark, d, baselines.uniform)), "total", "variance", places=3)


def hh_mixture_estimate(spark, d):
    return _rounded(baselines.hansen_hurwitz(_sampled(spark, d, baselines.mixture)), "total", "variance", places=3)


def ht_power_law_estimate(spark, d):
    return _rounded(baselines.horvitz_thompson(_sampled(spark, d, baselines.power_law), 300), "total", "variance", places=3)


def stratified_estimate(spark, d):
    return _rounded(baselines.stratified_total(corpus.run(spark, d).join(corpus.qrels(spark, d), ["topic_id", "pmid"]), 100, 20, 5), "total", places=6)


def score_distribution_cutoff(spark, d):
    rows = corpus.orders(spark, d).select("topic_id", "pmid", F.col("s").alias("score"), F.col("y").alias("rel"))
    return _rounded(baselines.score_cutoff(rows, rows, 0.95), "cutoff")


_SAMPLE_SQL = VOTES + """,
rk AS (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid, (o_orderstatus = 'F')::INT AS rel, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderpriority) AS n_docs FROM orders),
wt AS (SELECT *, {weight} AS w FROM rk),
pr AS (SELECT *, w / sum(w) OVER (PARTITION BY topic_id) AS p, (('0x' || substr(md5('5:' || pmid), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE AS uu FROM wt),
od AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY -ln(uu) / p) AS r FROM pr),
sm AS (SELECT *, 1 - exp(300 * ln(1 - p)) AS pi FROM od WHERE r <= 300)"""

QUERIES = {
    "route_summary": route_summary, "route_decisions": route_decisions, "scored_corpus": scored_corpus, "split_three_way": split_counts, "calib_test_split": calib_test_split,
    "vote_majority": vote_majority, "vote_include_share": vote_include_share, "vote_complete_ensembles": vote_complete_ensembles, "vote_cache_stats": vote_cache_stats, "vote_first_wins": vote_first_wins, "vote_topk_slots": vote_topk_slots,
    "purge_empty": purge_empty, "dry_run_calls": dry_run_calls, "quantile_scale": quantile_scale, "nested_subsample": nested_subsample, "nmin_compliance": nmin_compliance,
    "theta_breakpoints": theta_breakpoints, "theta_grid": theta_grid, "theta_risk_histogram": theta_risk_histogram, "hb_pvalues": hb_pvalues, "holm_reject": holm_reject,
    "walk_reject_safest": _walk("safest"), "walk_reject_riskiest": _walk("riskiest"), "walk_reject_tau_first": _walk("tau_first"), "theta_argmin": theta_argmin, "certify": certify_rule, "certify_walk": certify_walk,
    "wsr_lcb_anchors": wsr_lcb_anchors, "alpha_sweep": alpha_sweep, "budget_split": budget_split, "synthetic_corpus": synthetic_corpus, "synthetic_certificate": synthetic_certificate, "topic_fanout": topic_fanout, "walk_orders": walk_orders, "cross_topic_stats": cross_topic_stats, "theorem_violations": theorem_violations,
    "summary_with_mean": summary_with_mean, "slack_ratio": slack_ratio, "scrc_t_threshold": scrc_t_threshold, "scrc_i_threshold": scrc_i_threshold, "scrc_sweep": scrc_sweep, "reliability_bins": reliability_bins,
    "calibrated_scores": calibrated_scores, "wilson_ci": wilson_ci, "ht_ap_prior_estimate": ht_ap_prior_estimate, "hh_estimate": hh_estimate, "hh_mixture_estimate": hh_mixture_estimate, "ht_power_law_estimate": ht_power_law_estimate,
    "stratified_estimate": stratified_estimate, "score_distribution_cutoff": score_distribution_cutoff,
}


def _scrc_sql(tau_from: str, pos_from: str, alpha: float = 0.1, select: str = "round(tau, 9) AS tau, round({lambda_star}, 9) AS lambda_star") -> str:
    lambda_star = f"coalesce((SELECT max(s) FROM ps WHERE ps.topic_id = tq.topic_id AND i = floor({alpha!r}::DOUBLE * (n + 1) + 1e-12::DOUBLE) - 1), 0)"
    return f"""
tq AS (SELECT topic_id, quantile_cont(u, 0.1) AS tau FROM {tau_from} GROUP BY topic_id),
ps AS (SELECT c.topic_id, s, row_number() OVER (PARTITION BY c.topic_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY c.topic_id) AS n FROM {pos_from} c JOIN tq USING (topic_id) WHERE y = 1 AND u >= tau)
SELECT topic_id, {select.replace("{lambda_star}", lambda_star)} FROM tq"""


_HALVES = "hv AS (SELECT *, row_number() OVER (PARTITION BY topic_id, y ORDER BY md5('7:' || pmid), pmid) <= floor(0.5::DOUBLE * count(*) OVER (PARTITION BY topic_id, y) + 0.5) AS first_half FROM calib), one AS (SELECT * FROM hv WHERE first_half), two AS (SELECT * FROM hv WHERE NOT first_half)"


def _scrc_sweep_sql() -> str:
    parts = []
    for i, recall in enumerate((0.8, 0.9, 0.95)):
        for name, sides in (("scrc-t", ("calib", "calib")), ("scrc-i", ("one", "two"))):
            fitted = _scrc_sql(*sides, 1 - recall, "tau, {lambda_star} AS lambda_star")
            parts.append(f"""SELECT '{name}' AS method, topic_id, {recall!r}::DOUBLE AS target_recall, examined, round(r, 9) AS recall_achieved, round(CASE WHEN r >= {recall!r}::DOUBLE THEN w END, 9) AS wss,
CASE WHEN r IS NULL THEN 'no_positives' WHEN r >= {recall!r}::DOUBLE THEN 'ok' ELSE 'recall_missed' END AS wss_status
FROM (SELECT t.topic_id, count(*) FILTER (u >= tau AND s >= lambda_star) AS examined, count(*) FILTER (y = 1 AND u >= tau AND s >= lambda_star) / nullif(count(*) FILTER (y = 1), 0) AS r,
count(*) FILTER (NOT (u >= tau AND s >= lambda_star)) / count(*) - {(1 - recall)!r}::DOUBLE AS w FROM (SELECT * FROM scored WHERE is_split = 2) t JOIN (WITH {fitted}) f ON f.topic_id = t.topic_id GROUP BY t.topic_id)""")
    return _with(SCORED + ", " + _HALVES, "\nUNION ALL ".join(parts))


_UNIFORM = "(('0x' || substr(md5('0:{}:' || pmid), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE"


def _synthetic_sql() -> str:
    def beta(name: str, a: int, b: int) -> str:
        return f"list_sort([{', '.join(_UNIFORM.format(f'{name}{i}') for i in range(a + b - 1))}])[{a}]"

    return f"""ids AS (SELECT o_orderpriority AS topic_id, o_orderkey AS pmid FROM orders),
lab AS (SELECT *, ({_UNIFORM.format('y')} <= 0.05::DOUBLE)::INT AS y FROM ids),
sco AS (SELECT *, CASE WHEN y = 1 THEN {beta('p', 8, 2)} ELSE {beta('n', 2, 8)} END AS s, {beta('u', 5, 5)} AS u FROM lab),
syn AS (SELECT *, CASE WHEN {_UNIFORM.format('f')} <= 0.1::DOUBLE AND s BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE THEN 1 - y ELSE y END AS y_hat FROM sco)"""


def _walks_sql() -> str:
    orders = [("safest", 0, "lambda_lo, lambda_hi, tau DESC"), ("riskiest", 0, "lambda_lo DESC, lambda_hi DESC, tau"), ("tau_first", 0, "tau, lambda_hi, lambda_lo"), *[("random", i, f"md5('{i}:' || theta_idx)") for i in range(5)]]
    parts = [f"SELECT topic_id, '{n}' AS walk, {i}::INT AS seed, count(*) FILTER (f = 0) AS n_certified FROM (SELECT topic_id, max((p > {DELTA}::DOUBLE)::INT) OVER (PARTITION BY topic_id ORDER BY {o}, theta_idx ROWS UNBOUNDED PRECEDING) AS f FROM tested) GROUP BY topic_id" for n, i, o in orders]
    return _with(TESTED, "\nUNION ALL ".join(parts))


SQL = {
    "synthetic_corpus": _with(_synthetic_sql(), "SELECT topic_id, pmid, y, round(s, 9) AS s, round(u, 9) AS u, y_hat FROM syn"),
    "vote_majority": _with(MAJORITY, "SELECT pmid, n, n_include, n_exclude, majority, round(u, 9) AS u, y_hat FROM majority"),
    "vote_include_share": _with(VOTES, "SELECT pmid, round(avg((vote = 'Include')::INT), 9) AS u FROM votes GROUP BY pmid"),
    "vote_complete_ensembles": _with(MAJORITY, "SELECT pmid, n, n_include, n_exclude, majority, round(u, 9) AS u, y_hat FROM majority WHERE n = 5"),
    "vote_cache_stats": _with(VOTES, "SELECT slot, count(*) AS votes, count(DISTINCT pmid) AS documents FROM votes GROUP BY slot"),
    "vote_first_wins": "SELECT l_partkey AS model_id, l_linenumber AS seed_b, l_orderkey AS pmid, l_quantity AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1",
    "vote_topk_slots": "SELECT l_orderkey, count(*) AS n, max(r) AS slots, sum(l_linenumber)::BIGINT AS sum_slots FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r <= 3 GROUP BY l_orderkey",
    "purge_empty": "SELECT event_id, response FROM (SELECT event_id, CASE WHEN value < 10 THEN '{}' WHEN value < 20 THEN ' ' WHEN value < 30 THEN NULL ELSE props END AS response FROM events) WHERE response IS NOT NULL AND trim(response) NOT IN ('', '{}')",
    "dry_run_calls": _with(VOTES, "SELECT count(*) AS documents, count(*) FILTER (have = 3) AS cached, round(avg((have = 3)::INT), 9) AS hit_rate, sum(3 - have)::BIGINT AS calls FROM (SELECT o_orderkey, least(coalesce(n, 0), 3) AS have FROM orders LEFT JOIN (SELECT pmid, count(*) AS n FROM votes WHERE vote <> 'Uncertain' GROUP BY pmid) v ON v.pmid = o_orderkey)"),
    "scored_corpus": _with(SCORED, "SELECT topic_id, pmid, round(s, 9) AS s, round(u, 9) AS u, y, y_hat, is_split FROM scored"),
    "split_three_way": _with(SCORED, "SELECT topic_id, is_split, count(*) AS n, sum(y)::BIGINT AS positives FROM scored GROUP BY topic_id, is_split"),
    "calib_test_split": _with(SCORED, "SELECT topic_id, pmid, y, (row_number() OVER (PARTITION BY topic_id, y ORDER BY md5('42:' || pmid), pmid) <= floor(CASE WHEN sum(y) OVER (PARTITION BY topic_id) >= 10000 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * count(*) OVER (PARTITION BY topic_id, y) + 0.5))::INT AS is_calib FROM raw"),
    "quantile_scale": _with(SCORED, "SELECT topic_id, pmid, round(s, 9) AS s, y FROM sc"),
    "nested_subsample": _with(SCORED, "SELECT topic_id, pmid FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY md5(topic_id || ':42:' || pmid), pmid) AS r FROM calib WHERE y = 1) WHERE r <= 25"),
    "nmin_compliance": _with(SCORED, "SELECT topic_id, count(*) AS n, count(*) FILTER (y = 1) AS m_plus, count(*) FILTER (y = 1 AND is_split = 0) AS m_score, count(*) FILTER (y = 1 AND is_split = 1) AS m_calib, count(*) FILTER (y = 1 AND is_split = 2) AS m_test, round_even(avg(y), 4) AS prevalence, 26 AS n_min, count(*) FILTER (y = 1 AND is_split = 1) - 26 AS margin, CASE WHEN count(*) FILTER (y = 1 AND is_split = 1) >= 26 THEN 'PASS' ELSE 'ABSTAIN' END AS status FROM scored GROUP BY topic_id"),
    "theta_breakpoints": _with(GRID, "SELECT topic_id, i - 1 AS i, round(points[i], 9) AS point FROM (SELECT topic_id, points, unnest(range(1, len(points) + 1)) AS i FROM points)"),
    "theta_grid": _with(GRID, "SELECT topic_id, theta_idx, round(lambda_lo, 9) AS lambda_lo, round(lambda_hi, 9) AS lambda_hi, round(tau, 9) AS tau FROM grid"),
    "theta_risk_histogram": _with(GRID, "SELECT topic_id, theta_idx, m_plus, n_miss, n_slack, round(cost, 9) AS cost FROM risks"),
    "hb_pvalues": _with(TESTED, "SELECT topic_id, theta_idx, round(r_hat, 9) AS r_hat, round(p, 9) AS p FROM tested"),
    "holm_reject": _with(HOLM, "SELECT topic_id, theta_idx, certified FROM holm"),
    "walk_reject_safest": _walk_sql("lambda_lo, lambda_hi, tau DESC"),
    "walk_reject_riskiest": _walk_sql("lambda_lo DESC, lambda_hi DESC, tau"),
    "walk_reject_tau_first": _walk_sql("tau, lambda_hi, lambda_lo"),
    "theta_argmin": _with(HOLM, "SELECT topic_id, n_certified, theta_idx, round(lambda_lo, 9) AS lambda_lo, round(lambda_hi, 9) AS lambda_hi, round(tau, 9) AS tau FROM (SELECT *, count(*) FILTER (certified) OVER (PARTITION BY topic_id) AS n_certified, row_number() OVER (PARTITION BY topic_id ORDER BY CASE WHEN certified THEN cost ELSE 'inf'::DOUBLE END, theta_idx) AS r FROM holm) WHERE r = 1"),
    "route_decisions": _with(ROUTED, "SELECT topic_id, pmid, route, included, CASE WHEN s < 0.3::DOUBLE THEN 'auto_reject' WHEN s >= 0.7::DOUBLE THEN 'auto_accept' WHEN u < 0.6::DOUBLE THEN 'human_review' WHEN round_even(u * 5, 0) > 2.5 THEN 'llm_include' ELSE 'llm_exclude' END AS five_way FROM inc"),
    "route_summary": _with(EVALUATED, "SELECT * FROM summary"),
    "cross_topic_stats": _with(EVALUATED, "SELECT round(avg(fnr), 7) AS fnr_mean, round(stddev_pop(fnr) / sqrt(count(fnr)), 7) AS fnr_se, count(fnr) AS fnr_n, round(avg(llm_calls), 7) AS llm_calls_mean, round(stddev_pop(llm_calls) / sqrt(count(llm_calls)), 7) AS llm_calls_se, count(llm_calls) AS llm_calls_n FROM summary"),
    "theorem_violations": _with(EVALUATED, "SELECT count(*) AS certified, count(*) FILTER (fnr > 0.5) AS violations, round(avg((fnr <= 0.5)::INT), 9) AS pass_rate FROM summary"),
    "summary_with_mean": _with(EVALUATED, "SELECT topic_id, round(fnr, 7) AS fnr, round(recall, 7) AS recall FROM summary UNION ALL SELECT 'MEAN', round(avg(fnr), 7), round(avg(recall), 7) FROM summary"),
    "slack_ratio": _with(GRID, "SELECT topic_id, theta_idx, CASE WHEN n_slack > 0 THEN 0.5::DOUBLE END AS ratio FROM risks"),
    "scrc_t_threshold": _with(SCORED + ",", _scrc_sql("calib", "calib")),
    "scrc_i_threshold": _with(SCORED + ", " + _HALVES + ",", _scrc_sql("one", "two")),
    "reliability_bins": _with(SCORED, "SELECT floor(s * 10)::INT AS bin, count(*) AS n, round(avg(s), 7) AS mean_score, round(avg(y), 7) AS positive_rate FROM scored WHERE floor(s * 10) BETWEEN 0 AND 9 GROUP BY bin"),
    "wilson_ci": _with(SCORED, "SELECT topic_id, k, n, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS low, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS high FROM (SELECT topic_id, count(*) FILTER (y = 1 AND y_hat = 1)::DOUBLE AS k, count(*) FILTER (y = 1)::DOUBLE AS n FROM scored GROUP BY topic_id)"),
    "ht_ap_prior_estimate": _with(_SAMPLE_SQL.replace("{weight}", "ln((n_docs + 1) / rank)"), "SELECT topic_id, round(sum(rel / pi), 3) AS total, round(sum(rel * (1 - pi) / (pi * pi)), 3) AS variance FROM sm GROUP BY topic_id"),
    "hh_estimate": _with(_SAMPLE_SQL.replace("{weight}", "1 / n_docs"), "SELECT topic_id, round(avg(rel / p), 3) AS total, round(var_pop(rel / p) / (count(*) - 1), 3) AS variance FROM sm GROUP BY topic_id"),
    "stratified_estimate": _with(_SAMPLE_SQL.replace("{weight}", "1 / n_docs"), "SELECT topic_id, round(sum(rel * size / least(size, 20)), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, (rank - 1) // 100 ORDER BY md5('5:' || pmid), pmid) AS q, count(*) OVER (PARTITION BY topic_id, (rank - 1) // 100) AS size FROM rk) WHERE q <= 20 GROUP BY topic_id"),
    "scrc_sweep": _scrc_sweep_sql(),
    "walk_orders": _walks_sql(),
    "budget_split": _with(TESTED + """,
bs AS (SELECT *, row_number() OVER (PARTITION BY topic_id, delta_ltt ORDER BY p, theta_idx) - 1 AS i, count(*) OVER (PARTITION BY topic_id, delta_ltt) AS m FROM tested CROSS JOIN (SELECT unnest([0.05, 0.06, 0.07, 0.08, 0.09])::DOUBLE AS delta_ltt)),
hm AS (SELECT *, max((p > delta_ltt / (m - i))::INT) OVER (PARTITION BY topic_id, delta_ltt ORDER BY p, theta_idx ROWS UNBOUNDED PRECEDING) = 0 AS certified FROM bs)""",
        "SELECT topic_id, delta_ltt, n_certified, theta_idx FROM (SELECT *, count(*) FILTER (certified) OVER (PARTITION BY topic_id, delta_ltt) AS n_certified, row_number() OVER (PARTITION BY topic_id, delta_ltt ORDER BY CASE WHEN certified THEN cost ELSE 'inf'::DOUBLE END, theta_idx) AS r FROM hm) WHERE r = 1"),
    "hh_mixture_estimate": _with(_SAMPLE_SQL.replace("{weight}", "CASE WHEN rank <= 100 THEN 0.9::DOUBLE / least(n_docs, 100) ELSE (1 - 0.9::DOUBLE) / greatest(n_docs - least(n_docs, 100), 1) END"), "SELECT topic_id, round(avg(rel / p), 3) AS total, round(var_pop(rel / p) / (count(*) - 1), 3) AS variance FROM sm GROUP BY topic_id"),
    "ht_power_law_estimate": _with(_SAMPLE_SQL.replace("{weight}", "pow(rank::DOUBLE, -0.1::DOUBLE)"), "SELECT topic_id, round(sum(rel / pi), 3) AS total, round(sum(rel * (1 - pi) / (pi * pi)), 3) AS variance FROM sm GROUP BY topic_id"),
    "score_distribution_cutoff": f"WITH z AS (SELECT o_orderpriority AS topic_id, o_orderstatus = 'F' AS rel, (o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)), c AS (SELECT avg(z) + {inverse_normal(1 - 0.95)!r}::DOUBLE * stddev_pop(z) AS cutoff FROM z WHERE rel) SELECT topic_id, round(any_value(cutoff), 9) AS cutoff, count(*) FILTER (z >= cutoff) AS n_kept FROM z, c GROUP BY topic_id",
    "alpha_sweep": _with(GRID + f""",
sw AS (SELECT *, {_p_sql('alpha')} AS p FROM risks CROSS JOIN (SELECT unnest([0.01, 0.05, 0.1, 0.15, 0.2, 0.3])::DOUBLE AS alpha)),
st AS (SELECT *, row_number() OVER (PARTITION BY topic_id, alpha ORDER BY p, theta_idx) - 1 AS i, count(*) OVER (PARTITION BY topic_id, alpha) AS m FROM sw),
hm AS (SELECT *, max((p > {DELTA}::DOUBLE / (m - i))::INT) OVER (PARTITION BY topic_id, alpha ORDER BY p, theta_idx ROWS UNBOUNDED PRECEDING) = 0 AS certified FROM st)""",
        "SELECT topic_id, alpha, n_certified, theta_idx FROM (SELECT *, count(*) FILTER (certified) OVER (PARTITION BY topic_id, alpha) AS n_certified, row_number() OVER (PARTITION BY topic_id, alpha ORDER BY CASE WHEN certified THEN cost ELSE 'inf'::DOUBLE END, theta_idx) AS r FROM hm) WHERE r = 1"),
}
SQL["topic_fanout"] = SQL["theta_argmin"]
SQL["synthetic_certificate"] = SQL["theta_argmin"].replace(SCORED, _synthetic_sql() + ",\ncalib AS (SELECT * REPLACE ('all' AS topic_id) FROM syn)")
