"""Recall sweeps: every stopping method at every target recall of every topic, in one job.

A topic's ranking is counted once, in cells between the stops of all methods; what a method has seen and found
at its stops is a prefix sum over the cells. Methods and targets are rows of a small table, not loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stopping import batch_ends, window_counts

#: Growth of the batches by method.
BATCHES = {"batches_10": (1, 0.1), "batches_50": (1, 0.5), "batches_fixed": (100, 0.0)}


def stops(judged: DataFrame, methods: dict[str, tuple[int, float]] = BATCHES, windows: int = 100) -> DataFrame:
    """topic_id, method, examined, found, n_docs, n_rel at each stop of each method; ``judged`` has topic_id, rank, rel, n_docs, n_rel.

    Methods are the named batches, "windows" (hundredths of the ranking, its tail unseen) and "all" (one stop, at the end).
    """
    from pyspark.ml.feature import Bucketizer

    spark = judged.sparkSession
    most = judged.agg(F.max("n_docs")).first()[0] or 0
    ends = {m: batch_ends(most, *how) for m, how in methods.items()} if most else {m: [] for m in methods}
    cuts = sorted({e for own in ends.values() for e in own})
    cells = Bucketizer(splits=[float("-inf"), 0.5, *(c + 0.5 for c in cuts), float("inf")], inputCol="__rank", outputCol="__cell").transform(judged.withColumn("__rank", F.col("rank").cast("double")))
    sums = cells.groupBy("topic_id", "n_docs", "n_rel", F.col("__cell").cast("int").alias("__cell")).agg(F.count("*").alias("n"), F.sum("rel").cast("long").alias("hits"))
    along = Window.partitionBy("topic_id").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select("topic_id", "n_docs", "n_rel", "__cell", F.sum("n").over(along).alias("examined"), F.sum("hits").over(along).alias("found"))
    # the stop in a method's last batch is the ranking's end, wherever that lies
    last = run.withColumn("__next", F.lead("__cell").over(Window.partitionBy("topic_id").orderBy("__cell")))
    at = {c: i for i, c in enumerate(cuts, 1)}
    table = spark.createDataFrame([(m, at[e]) for m, own in ends.items() for e in own], "method string, __cell int")
    inner = last.where("__next is not null").join(F.broadcast(table), "__cell")  # a number of stops logarithmic, or in hundreds, of a topic's documents
    names = F.explode(F.array(*[F.lit(m) for m in (*methods, "all")]))
    outer = last.where("__next is null").withColumn("method", names)
    counted = window_counts(judged, windows).join(judged.groupBy("topic_id").agg(F.first("n_docs").alias("n_docs"), F.first("n_rel").alias("n_rel")), "topic_id")
    each = counted.select("topic_id", "n_docs", "n_rel", F.posexplode(F.arrays_zip("n", "hits")).alias("w", "x")).select("topic_id", "n_docs", "n_rel", "w", "x.n", "x.hits")
    by = Window.partitionBy("topic_id").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    seen = each.select("topic_id", F.lit("windows").alias("method"), F.sum("n").over(by).alias("examined"), F.sum("hits").over(by).alias("found"), "n_docs", "n_rel")
    columns = ["topic_id", "method", "examined", "found", "n_docs", "n_rel"]
    return inner.select(columns).unionByName(outer.select(columns)).unionByName(seen.select(columns))


def recall_sweep(points: DataFrame, targets: list[float], gate: float = 0.95) -> DataFrame:
    """method, topic_id, target_recall, examined, recall_achieved, fnr, wss_95, wss_status of the first stop that reaches each target.

    A method that never reaches it ends at its last stop. wss_95 is the share left out less 1 - ``gate``, where the
    recall reaches ``gate``.
    """
    spark = points.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets], "target_recall double")
    rows = points.join(F.broadcast(wanted))  # len(targets) rows
    reached = F.col("found") >= F.col("target_recall") * F.col("n_rel") - 1e-9
    best = rows.groupBy("topic_id", "method", "target_recall").agg(F.min_by(F.struct("examined", "found", "n_docs", "n_rel"), F.struct((~reached).cast("int"), F.when(reached, F.col("examined")).otherwise(-F.col("examined")))).alias("b"))
    recall = F.col("b.found") / F.nullif("b.n_rel", F.lit(0))
    wss = (F.col("b.n_docs") - F.col("b.examined")) / F.col("b.n_docs") - (1 - gate)
    status = F.when(recall.isNull(), "no_positives").when(recall >= gate, "ok").otherwise("recall_missed")
    return best.select("method", "topic_id", "target_recall", F.col("b.examined").alias("examined"), recall.alias("recall_achieved"), (1 - recall).alias("fnr"), F.when(recall >= gate, wss).alias("wss_95"), status.alias("wss_status"))


def with_baselines(sweep: DataFrame, results: DataFrame, methods: list[str]) -> DataFrame:
    """The sweep's rows (topic_id, alpha, ..) with fnr_<method> of each method at recall 1 - alpha."""
    at = F.round(1 - F.col("target_recall"), 9).alias("alpha")
    wide = results.select("topic_id", at, "method", "fnr").groupBy("topic_id", "alpha").pivot("method", methods).agg(F.first("fnr"))
    wide = wide.select("topic_id", F.col("alpha").alias("__alpha"), *[F.col(m).alias(f"fnr_{m}") for m in methods])
    return sweep.join(wide, (sweep["topic_id"] == wide["topic_id"]) & (F.round(sweep["alpha"], 9) == wide["__alpha"]), "left").drop(wide["topic_id"], wide["__alpha"])
