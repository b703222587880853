"""Where to stop screening a ranking: knees of its gain curve, and a policy that steps through its windows.

A ranking's curve has one point for each batch, and batches grow, so a topic has a number of points that is
logarithmic in its documents, and a policy a fixed number of windows: what is gathered for a topic is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_ends(n: int, batch: int = 1, growth: float = 0.1) -> list[int]:
    """Documents assessed after each batch, until all n are; a batch is ``growth`` larger than the one before."""
    ends, size = [], batch
    while not ends or ends[-1] < n:
        ends.append(min(n, (ends[-1] if ends else 0) + size))
        size += math.ceil(size * growth)
    return ends


def gain_points(judged: DataFrame, batch: int = 1, growth: float = 0.1) -> DataFrame:
    """topic_id, assessed, found after each batch of a ranking (topic_id, rank, rel)."""
    from pyspark.ml.feature import Bucketizer

    most = judged.agg(F.max("rank")).first()[0]
    if not most:
        return judged.select("topic_id", F.col("rank").cast("long").alias("assessed"), F.col("rel").cast("long").alias("found")).limit(0)
    cuts = [0.5, *(x + 0.5 for x in batch_ends(most, batch, growth))]
    if len(cuts) < 3:
        cuts.append(float("inf"))
    found = Bucketizer(splits=cuts, inputCol="__rank", outputCol="__batch").transform(judged.select("topic_id", "rank", "rel", F.col("rank").cast("double").alias("__rank")))
    sums = found.groupBy("topic_id", "__batch").agg(F.max("rank").cast("long").alias("assessed"), F.sum("rel").alias("__new"))
    return sums.select("topic_id", "assessed", F.sum("__new").over(Window.partitionBy("topic_id").orderBy("__batch").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("found"))


def knee_points(curve: DataFrame, x: str, y: str, keys: list[str] = ["topic_id"], window: int = 1, sensitivity: float = 10) -> DataFrame:  # noqa: B006
    """keys, x, y of the knees of each key's curve, by the rule of ``numeric.knee``; a curve has a bounded number of points."""
    along, whole = Window.partitionBy(*keys).orderBy("__x"), Window.partitionBy(*keys)
    rows = curve.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    rows = rows.withColumns({"__i": F.row_number().over(along) - 1, "__n": F.count("*").over(whole)})
    near = {o: F.when((F.col("__i") + o >= 0) & (F.col("__i") + o < F.col("__n") - 1), F.lit(math.exp(-0.5 * (o / window) ** 2))).otherwise(0.0) for o in range(-window, window)}
    total = sum(near.values(), F.lit(0.0))
    smooth = {f"__{c}s": sum((w * F.coalesce(F.lag(f"__{c}", -o).over(along) if o else F.col(f"__{c}"), F.lit(0.0)) for o, w in near.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0)) for c in "xy"}
    rows = rows.withColumns(smooth)
    scaled = {c: (F.col(f"__{c}s") - F.min(f"__{c}s").over(whole)) / F.coalesce(F.nullif(F.max(f"__{c}s").over(whole) - F.min(f"__{c}s").over(whole), F.lit(0.0)), F.lit(1.0)) for c in "xy"}
    rows = rows.withColumns({"__gap": scaled["y"] - scaled["x"], "__sx": scaled["x"]})
    all_ = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.lit(float(sensitivity)) * (F.last("__sx").over(all_) - F.first("__x").over(all_)) / (F.col("__n") - 1)
    rows = rows.withColumns({"__top": (F.lag("__gap").over(along) < F.col("__gap")) & (F.col("__gap") > F.lead("__gap").over(along)), "__limit": limit})
    part = F.count_if("__top").over(along.rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.withColumn("__part", part).where("__part > 0").groupBy(*keys, "__part").agg(F.min_by(F.struct("__x", "__y", "__gap", "__limit"), "__i").alias("top"), F.min("__gap").alias("__low"))
    return tops.where(F.col("__low") < F.col("top.__gap") - F.col("top.__limit")).select(*keys, F.col("top.__x").alias(x), F.col("top.__y").alias(y))


Policy = Callable[[Column, Column], Column]


def window_counts(judged: DataFrame, windows: int = 100) -> DataFrame:
    """topic_id and arrays over the windows: documents (n), relevant ones (hits), and the state's rates, hits / windows.

    Windows have N // ``windows`` documents, one at least; the ranking's tail belongs to none.
    """
    size = F.greatest(F.floor(F.col("n_docs") / windows), F.lit(1))
    at = F.floor((F.col("rank") - 1) / size).cast("int")
    sums = judged.withColumn("__at", at).where(F.col("__at") < windows).groupBy("topic_id", "__at").agg(F.count("*").alias("n"), F.sum("rel").cast("long").alias("hits"))
    held = sums.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("__at", F.struct("n", "hits")))).alias("__m"))
    every = F.sequence(F.lit(0), F.lit(windows - 1))

    def of(field: str) -> Column:
        return F.transform(every, lambda i: F.coalesce(F.try_element_at("__m", i)[field], F.lit(0).cast("long")))

    return held.select("topic_id", of("n").alias("n"), of("hits").alias("hits")).withColumn("rates", F.transform("hits", lambda h: h / F.lit(float(windows))))


def threshold_policy(recent: int = 5) -> Policy:
    """Stop where the mean rate of the ``recent`` last windows seen is below the topic's threshold for the place (a column ``thresholds``)."""

    def stop(state: Column, at: Column) -> Column:
        first = F.greatest(at - (recent - 1), F.lit(0))
        seen = F.slice(state, first + 1, at - first + 1)
        return F.aggregate(seen, F.lit(0.0), lambda a, v: a + v) / F.size(seen) < F.element_at("thresholds", at + 1)

    return stop


def with_thresholds(topics: DataFrame, table: DataFrame) -> DataFrame:
    """The policy table (location, threshold), one row for each window, as the array that threshold_policy() reads."""
    rows = table.select(F.array_sort(F.collect_list(F.struct("location", F.col("threshold").cast("double").alias("threshold")))).alias("rows"))
    return topics.withColumn("thresholds", rows.select(F.transform("rows", lambda r: r["threshold"])).scalar())


def follow(topics: DataFrame, policy: Policy, target: float, windows: int = 100) -> DataFrame:
    """One row for each topic of ``window_counts``: where the policy ends, and what that earns.

    A step shows the policy the rates of the windows seen (-1 for others). To go on moves one window ahead, but
    for the first time, when the first window is seen. A run ends with the policy's word to stop, or with the
    last window. A step's reward falls from 1 to nearly 0 up to the target's window and from there to -1 at the end;
    the target is the first window where the recall of all windows' relevant documents is reached. Topics
    without relevant documents have neither target nor reward.
    """
    run = F.aggregate("hits", F.array().cast("array<long>"), lambda a, h: F.array_append(a, h + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))))
    rows = topics.withColumn("__run", run).withColumn("__all", F.element_at("__run", -1).cast("double"))
    goal = F.array_position(F.transform("__run", lambda c: c / F.nullif(F.col("__all"), F.lit(0.0)) >= target), F.lit(True)) - 1
    rows = rows.withColumn("target", F.when((F.col("__all") > 0) & (goal >= 0), goal.cast("int")))

    def reward(at: Column) -> Column:
        place, t = at + 1, F.col("target") + 1
        return F.when(place <= t, 1 - (place - 1) / t).otherwise((t - place) / F.nullif(windows - t, F.lit(0)))

    def step(s: Column, _: Column) -> Column:
        seen = F.transform("rates", lambda r, i: F.when(i <= s["at"], r).otherwise(-1.0))
        stop = policy(seen, s["at"])
        ends = ~stop & (s["at"] >= windows - 2) | (s["at"] >= windows - 1)
        at = F.when(stop | s["first"], s["at"]).otherwise(F.least(s["at"] + 1, F.lit(windows - 1)))
        after = F.struct(at.cast("int").alias("at"), (s["first"] & stop).alias("first"), (stop | ends).alias("over"), stop.alias("stopped"), (s["steps"] + 1).alias("steps"), (s["total"] + F.coalesce(reward(at), F.lit(0.0))).alias("total"))
        return F.when(s["over"], s).otherwise(after)

    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("first"), F.lit(False).alias("over"), F.lit(False).alias("stopped"), F.lit(0).alias("steps"), F.lit(0.0).alias("total"))
    rows = rows.withColumn("__end", F.aggregate(F.sequence(F.lit(0), F.lit(windows)), start, step))
    end = F.col("__end.at")
    place = end + 1
    cost = (place - F.col("target")) / windows / (1 - F.col("target") / windows)
    return rows.select(
        "topic_id", end.alias("location"), "target", (end - F.col("target")).alias("distance"), F.col("__end.stopped").alias("stopped"), F.col("__end.steps").alias("steps"),
        F.aggregate(F.slice("n", 1, place), F.lit(0).cast("long"), lambda a, v: a + v).alias("examined"), F.round(F.element_at("__run", place) / F.nullif("__all", F.lit(0.0)), 3).alias("recall"),
        F.round(place / windows, 3).alias("cost"), F.round(cost, 3).alias("e_cost"), F.when(F.col("target").isNotNull(), reward(end)).alias("reward"), F.when(F.col("target").isNotNull(), F.col("__end.total")).alias("total_reward"))
