"""Queries of stopping rules, estimators with joint probabilities and recall sweeps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, evaluator, learning, stopping, sweeps
from ..session import landed, table
from . import corpus
from .screening_queries import _SAMPLE_SQL, _sampled, _with

TARGETS = [0.8, 0.9, 0.95, 0.99]


def _judged(spark, d):
    return evaluator.judged_run(corpus.run(spark, d), corpus.qrels(spark, d))


def gain_points(spark, d):
    return stopping.gain_points(_judged(spark, d))


def knee_points(spark, d):
    # a sensitivity of half a step: the ranking by price knows nothing of the status
    return stopping.knee_points(stopping.gain_points(_judged(spark, d)), "assessed", "found", sensitivity=0.5)


def ht_joint_variances(spark, d):
    got = baselines.joint_variances(_sampled(spark, d, baselines.ap_prior), 300, None)
    return got.withColumns({c: F.round(c, 3) for c in ("total", "variance1", "variance2")})


def _policy(spark):
    """Thresholds of a falling patience: none in the first 20 windows, then rising to 0.3."""
    return spark.range(100).select(F.col("id").cast("int").alias("location"), F.when(F.col("id") < 20, 0.0).otherwise((F.col("id") - 20) / 80.0 * 0.3).alias("threshold"))


def stopping_policy(spark, d):
    topics = stopping.with_thresholds(stopping.window_counts(_judged(spark, d)), _policy(spark))
    got = stopping.follow(topics, stopping.threshold_policy(5), 0.8)
    return got.withColumns({c: F.round(c, 6) for c in ("reward", "total_reward")})


def recall_sweep(spark, d):
    got = sweeps.recall_sweep(sweeps.stops(landed(_judged(spark, d), "sweep")), TARGETS)
    return got.withColumns({c: F.round(c, 9) for c in ("recall_achieved", "fnr", "wss_95")})


def baseline_fnr(spark, d):
    results = sweeps.recall_sweep(sweeps.stops(landed(_judged(spark, d), "sweep")), [0.8, 0.9, 0.95])
    alphas = spark.createDataFrame([(0.05,), (0.1,), (0.2,)], "alpha double")
    base = corpus.orders(spark, d).select("topic_id").distinct().join(F.broadcast(alphas))
    got = sweeps.with_baselines(base, results, ["batches_10", "windows", "all"])
    return got.withColumns({c: F.round(c, 9) for c in ("fnr_batches_10", "fnr_windows", "fnr_all")})


TOPIC = "licensed under the general public license version"


def _texts(spark, d):
    rel = F.coalesce(F.col("text"), F.lit("")).contains("General Public License").cast("int")
    return table(spark, d, "documents").select(F.col("doc_id").alias("pmid"), "text", rel.alias("rel"))


def _text_learning(spark, d, ranker):
    rows = landed(learning.kept_terms(_texts(spark, d)), "learning-terms")
    features = learning.tfidf(rows)
    topic = landed(features(spark.createDataFrame([(TOPIC,)], "text string")), "learning-topic")
    return learning.autotar(features(rows), 0.9, batch=20, growth=1.0, topic=topic, ranker=ranker)


def text_learning_logistic(spark, d):
    return _text_learning(spark, d, learning.logistic())


def text_learning_svm(spark, d):
    return _text_learning(spark, d, learning.linear_svm())


def text_learning_trees(spark, d):
    return _text_learning(spark, d, learning.boosted_trees())


QUERIES = {f.__name__: f for f in (gain_points, knee_points, ht_joint_variances, stopping_policy, recall_sweep, baseline_fnr, text_learning_logistic, text_learning_svm, text_learning_trees)}

_RANKED = """rk AS (SELECT o_orderpriority AS topic_id, (o_orderstatus = 'F')::INT AS rel, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderpriority) AS n_docs, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_orderpriority) AS n_rel FROM orders)"""
_BATCHES = """bt(k, size, low, high) AS (SELECT 0, 1::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, size + ceil(size * {growth})::BIGINT, high, high + size + ceil(size * {growth})::BIGINT FROM bt WHERE high < (SELECT count(*) FROM orders))"""
_POINTS = f"WITH RECURSIVE {_BATCHES.format(growth='0.1::DOUBLE')}, {_RANKED}, pt AS (SELECT topic_id, max(rank) AS assessed, sum(sum(rel)) OVER (PARTITION BY topic_id ORDER BY k)::BIGINT AS found FROM rk JOIN bt ON rank > low AND rank <= high GROUP BY topic_id, k)"
_KNEES = _POINTS + """,
ix AS (SELECT topic_id, assessed::DOUBLE AS x, found::DOUBLE AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY topic_id) AS n, lag(assessed) OVER w AS px, lag(found) OVER w AS py FROM pt WINDOW w AS (PARTITION BY topic_id ORDER BY assessed)),
sm AS (SELECT *, CASE WHEN i = 0 THEN x WHEN i = n - 1 THEN px ELSE (exp(-0.5::DOUBLE) * px + x) / (exp(-0.5::DOUBLE) + 1) END AS sx, CASE WHEN i = 0 THEN y WHEN i = n - 1 THEN py ELSE (exp(-0.5::DOUBLE) * py + y) / (exp(-0.5::DOUBLE) + 1) END AS sy FROM ix),
sc AS (SELECT *, (sx - min(sx) OVER t) / coalesce(nullif(max(sx) OVER t - min(sx) OVER t, 0), 1) AS ux, (sy - min(sy) OVER t) / coalesce(nullif(max(sy) OVER t - min(sy) OVER t, 0), 1) AS uy FROM sm WINDOW t AS (PARTITION BY topic_id)),
gp AS (SELECT *, uy - ux AS gap, 0.5::DOUBLE * (last_value(ux) OVER t - first_value(x) OVER t) / (n - 1) AS step FROM sc WINDOW t AS (PARTITION BY topic_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
mx AS (SELECT *, coalesce(lag(gap) OVER w < gap AND gap > lead(gap) OVER w, false) AS top FROM gp WINDOW w AS (PARTITION BY topic_id ORDER BY i)),
pa AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY topic_id ORDER BY i) AS part FROM mx)
SELECT topic_id, arg_min(x, i) AS assessed, arg_min(y, i) AS found FROM pa WHERE part > 0 GROUP BY topic_id, part HAVING min(gap) < arg_min(gap, i) - arg_min(step, i)"""

_STOPS = """WITH RECURSIVE a(k, size, low, high) AS (SELECT 0, 1::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, size + ceil(size * 0.1::DOUBLE)::BIGINT, high, high + size + ceil(size * 0.1::DOUBLE)::BIGINT FROM a WHERE high < (SELECT count(*) FROM orders)),
b(k, size, low, high) AS (SELECT 0, 1::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, size + ceil(size * 0.5::DOUBLE)::BIGINT, high, high + size + ceil(size * 0.5::DOUBLE)::BIGINT FROM b WHERE high < (SELECT count(*) FROM orders)),
""" + _RANKED + """,
seen AS (SELECT *, sum(rel) OVER (PARTITION BY topic_id ORDER BY rank) AS found FROM rk),
ends AS (SELECT 'batches_10' AS method, high FROM a UNION ALL SELECT 'batches_50', high FROM b UNION ALL SELECT 'batches_fixed', 100 * i FROM (SELECT unnest(range(1, (SELECT count(*) // 100 + 2 FROM orders))) AS i)),
st AS (SELECT topic_id, method, rank AS examined, found, n_docs, n_rel FROM seen JOIN ends ON rank = high WHERE rank < n_docs
  UNION ALL SELECT topic_id, method, rank, found, n_docs, n_rel FROM seen CROSS JOIN (SELECT unnest(['batches_10', 'batches_50', 'batches_fixed', 'all']) AS method) WHERE rank = n_docs
  UNION ALL SELECT topic_id, 'windows', max(rank), max(found), any_value(n_docs), any_value(n_rel) FROM seen WHERE rank <= 100 * greatest(n_docs // 100, 1) GROUP BY topic_id, (rank - 1) // greatest(n_docs // 100, 1)),
sw AS (SELECT *, found >= t * n_rel - 1e-9::DOUBLE AS ok FROM st CROSS JOIN (SELECT unnest({targets})::DOUBLE AS t)),
be AS (SELECT topic_id, method, t AS target_recall, row_number() OVER (PARTITION BY topic_id, method, t ORDER BY (NOT ok)::INT, CASE WHEN ok THEN examined ELSE -examined END) AS r, examined, found / n_rel AS recall, n_docs FROM sw)"""

SQL = {
    "gain_points": _POINTS + " SELECT * FROM pt",
    "knee_points": _KNEES,
    "ht_joint_variances": _with(_SAMPLE_SQL.replace("{weight}", "ln((n_docs + 1) / rank)") + """,
tt AS (SELECT topic_id, any_value(n_docs) AS n, count(*) AS v, sum(rel / pi) AS total FROM sm GROUP BY topic_id),
dg AS (SELECT topic_id, sum(1 / (pi * pi) - 1 / pi) AS own FROM sm WHERE rel = 1 GROUP BY topic_id),
cr AS (SELECT a.topic_id, sum(1 / (a.pi * b.pi) - 1 / (a.pi + b.pi - 1 + pow(1 - a.p - b.p, 300))) AS pairs FROM sm a JOIN sm b ON a.topic_id = b.topic_id AND a.pmid <> b.pmid WHERE a.rel = 1 AND b.rel = 1 GROUP BY a.topic_id),
sq AS (SELECT topic_id, sum((v * rel / pi - total) ** 2) AS s FROM sm JOIN tt USING (topic_id) GROUP BY topic_id)""",
        "SELECT topic_id, round(total, 3) AS total, round(own + pairs, 3) AS variance1, round((n - v) / n / v / (v - 1) * s, 3) AS variance2 FROM tt JOIN dg USING (topic_id) JOIN cr USING (topic_id) JOIN sq USING (topic_id)"),
    "stopping_policy": f"WITH {_RANKED}" + """,
wn AS (SELECT topic_id, ((rank - 1) // greatest(n_docs // 100, 1))::INT AS i, count(*) AS n, sum(rel) AS hits FROM rk GROUP BY ALL),
al AS (SELECT topic_id, i::INT AS i, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT topic_id FROM rk) CROSS JOIN (SELECT unnest(range(100)) AS i) LEFT JOIN wn USING (topic_id, i)),
cu AS (SELECT *, sum(hits) OVER t AS run, sum(n) OVER t AS seen, avg(hits / 100.0::DOUBLE) OVER (PARTITION BY topic_id ORDER BY i ROWS 4 PRECEDING) AS recent, sum(hits) OVER (PARTITION BY topic_id) AS total FROM al WINDOW t AS (PARTITION BY topic_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
tg AS (SELECT topic_id, min(i) FILTER (run / total >= 0.8::DOUBLE) AS target, coalesce(min(i) FILTER (i < 99 AND recent < CASE WHEN i < 20 THEN 0 ELSE (i - 20) / 80.0::DOUBLE * 0.3::DOUBLE END), 99) AS location, bool_or(i < 99 AND recent < CASE WHEN i < 20 THEN 0 ELSE (i - 20) / 80.0::DOUBLE * 0.3::DOUBLE END) AS stopped FROM cu GROUP BY topic_id),
rw AS (SELECT topic_id, unnest(range(100))::INT AS i, target, CASE WHEN i + 1 <= target + 1 THEN 1 - i / (target + 1) ELSE -1.0::DOUBLE * (i - target) / nullif(100 - (target + 1), 0) END AS reward FROM tg),
su AS (SELECT topic_id, sum(reward) FILTER (rw.i <= location) AS along, any_value(reward) FILTER (rw.i = location) AS last FROM rw JOIN tg USING (topic_id) GROUP BY topic_id)
SELECT tg.topic_id, location, tg.target, location - tg.target AS distance, stopped, location + 1 + stopped::INT - (location = 0 AND stopped)::INT AS steps, seen::BIGINT AS examined, round(run / total, 3) AS recall, round((location + 1) / 100, 3) AS cost, round((location + 1 - tg.target) / 100 / (1 - tg.target / 100), 3) AS e_cost, round(last, 6) AS reward, round(along + CASE WHEN stopped AND location > 0 THEN last ELSE 0 END, 6) AS total_reward
FROM tg JOIN su USING (topic_id) JOIN cu ON cu.topic_id = tg.topic_id AND cu.i = tg.location""",
    "recall_sweep": _STOPS.replace("{targets}", repr(TARGETS)) + " SELECT method, topic_id, target_recall, examined, round(recall, 9) AS recall_achieved, round(1 - recall, 9) AS fnr, round(CASE WHEN recall >= 0.95::DOUBLE THEN (n_docs - examined) / n_docs - (1 - 0.95::DOUBLE) END, 9) AS wss_95, CASE WHEN recall IS NULL THEN 'no_positives' WHEN recall >= 0.95::DOUBLE THEN 'ok' ELSE 'recall_missed' END AS wss_status FROM be WHERE r = 1",
    "baseline_fnr": _STOPS.replace("{targets}", "[0.8, 0.9, 0.95]") + " SELECT topic_id, round(1 - target_recall, 9) AS alpha, round(max(1 - recall) FILTER (method = 'batches_10'), 9) AS fnr_batches_10, round(max(1 - recall) FILTER (method = 'windows'), 9) AS fnr_windows, round(max(1 - recall) FILTER (method = 'all'), 9) AS fnr_all FROM be WHERE r = 1 GROUP BY topic_id, target_recall",
}
