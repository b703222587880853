"""Landed model replies: where a run of failures aborts a topic, and whether a certificate's prompt template is still in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a topic's sequence that are looked at together.
BLOCK = 4096


def failure_runs(replies: DataFrame, most: int = 10, keys: list[str] = ["topic_id"], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """keys, total, processed, failed, aborted, aborted_at: ``replies`` has keys, seq (an integer place) and failed.

    A topic is aborted at the reply that makes ``most`` failures in a row; replies behind it are not processed. Runs
    are put together from blocks of ``block`` places: each knows its failures in front, those at its end and its own
    first abort, so that no task goes through a whole topic.
    """
    each = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("failed", F.lit(False)).alias("failed"))))
    blocks = replies.groupBy(*keys, F.floor(F.col("seq") / block).alias("block")).agg(each.alias("rows"))
    start = F.struct(F.lit(0).alias("run"), F.lit(None).cast("long").alias("at"))

    def go_on(s: Column, r: Column) -> Column:
        run = F.when(r["failed"], s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.when(s["at"].isNotNull(), s["at"]).when(run >= most, r["seq"].cast("long")).alias("at"))

    good = F.array_position(F.transform("rows", lambda r: ~r["failed"]), F.lit(True))
    blocks = blocks.withColumn("own", F.aggregate("rows", start, go_on)).withColumn("lead", F.when(good > 0, (good - 1).cast("int")).otherwise(F.size("rows")))
    blocks = blocks.select(*keys, "block", F.size("rows").alias("n"), "lead", (F.col("lead") == F.size("rows")).alias("bad"), F.col("own.run").alias("tail"), F.col("own.at").alias("at"), F.transform(F.slice("rows", 1, most), lambda r: r["seq"].cast("long")).alias("first"))
    along = Window.partitionBy(*keys).orderBy("block")  # rows / block of them
    # failures that reach a block from those before it: all of the blocks without a success since the last one with, and that one's tail
    blocks = blocks.withColumn("part", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(*keys, "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"part": F.coalesce("part", F.lit(0)), "last": F.coalesce(F.lag(F.when(F.col("bad"), 0).otherwise(F.col("tail"))).over(along), F.lit(0))})
    carried = F.coalesce(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).over(inside), F.lit(0)) + F.first("last").over(Window.partitionBy(*keys, "part").orderBy("block"))
    blocks = blocks.withColumn("carried", carried)
    early = F.when((F.col("carried") > 0) & (F.col("carried") < most) & (F.col("carried") + F.col("lead") >= most), F.try_element_at("first", (most - F.col("carried")).cast("int")))
    ends = blocks.groupBy(*keys).agg(F.min(F.least("at", early)).alias("aborted_at"))
    rows = replies.join(ends, keys)
    seen = F.col("aborted_at").isNull() | (F.col("seq") <= F.col("aborted_at"))
    return rows.groupBy(*keys, "aborted_at").agg(F.count("*").alias("total"), F.count_if(seen).alias("processed"), F.count_if(seen & F.col("failed")).alias("failed")).withColumn("aborted", F.col("aborted_at").isNotNull())


def template_status(recorded: Column, template: Column) -> Column:
    """ok, mismatch, or unrecorded: the hash that a certificate was made with against that of the template in use."""
    return F.when(F.coalesce(recorded, F.lit("")) == "", "unrecorded").when(recorded == F.sha2(template, 256), "ok").otherwise("mismatch")


def require_template(certificates: DataFrame, recorded: str, template: str) -> DataFrame:
    """The certificates with template_status; a mismatch is an error."""
    out = certificates.withColumn("template_status", template_status(F.col(recorded), F.lit(template)))
    if not out.where("template_status = 'mismatch'").isEmpty():
        raise ValueError("a certificate was made with another prompt template: score again")
    return out
