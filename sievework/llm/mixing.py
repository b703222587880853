"""Mixing sources to target weights by cube-method balanced sampling.

A source's target, divided by its size, is how often each of its documents should be taken: a whole
part, taken for certain, and a fraction, an inclusion probability. The flight phase moves these
probabilities along vectors in the null space of two balancing constraints (words and documents), so
both totals stay as they are while document after document reaches 0 or 1. Sources are flown in
chunks of bounded size, the few probabilities that a chunk leaves open meet in the next level, and
only the last one or two of a source land: there the document constraint goes first, then the last
document is drawn. Draws depend on the identifiers alone, so reruns agree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take in all, as a share of all words, and a source's most, as a multiple of its size.
SHARE, MOST = 1.5, 2.0
#: Documents that fly together.
CHUNK = 1024
_EPS = 1e-9


def flight(sizes: list[float], probs: list[float], draw: random.Random, land: bool = False) -> list[float]:
    """The cube method's flight phase for the constraints sum(size) and count; with ``land``, its landing too.

    Without landing, at most two probabilities stay strictly between 0 and 1. Units that come first
    are settled first: give large ones first, so that small ones land.
    """
    probs = list(probs)
    queue = iter([k for k, p in enumerate(probs) if _EPS < p < 1 - _EPS])
    open_: list[int] = []

    def move(units: list[int], u: tuple[float, ...]) -> None:
        up = min((1 - probs[k]) / d if d > 0 else probs[k] / -d for k, d in zip(units, u, strict=True) if d)
        down = min(probs[k] / d if d > 0 else (1 - probs[k]) / -d for k, d in zip(units, u, strict=True) if d)
        step = up if draw.random() * (up + down) < down else -down
        for k, d in zip(units, u, strict=True):
            p = probs[k] + step * d
            probs[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p

    while True:
        while len(open_) < 3 and (k := next(queue, None)) is not None:
            open_.append(k)
        if len(open_) < 3:
            break
        a, b, c = (sizes[k] for k in open_)
        u = (b - c, c - a, a - b)
        top = max(map(abs, u))
        move(open_, tuple(x / top for x in u) if top else (1.0, -1.0, 0.0))
        open_ = [k for k in open_ if 0 < probs[k] < 1]
    if len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]:
        move(open_, (1.0, -1.0))
        open_ = [k for k in open_ if 0 < probs[k] < 1]
    if land:
        if len(open_) == 2:  # the document constraint is given up
            a, b = (sizes[k] for k in open_)
            top = max(a, b)
            move(open_, (b / top, -a / top))
            open_ = [k for k in open_ if 0 < probs[k] < 1]
        for k in open_:
            probs[k] = float(draw.random() < probs[k])
    return probs


def _fly(level: int, last: bool):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "n"], ascending=[False, True, True], kind="stable")
        draw = random.Random(f"{level}:{key[1]}:{','.join(map(str, rows['doc_id'].head(8)))}")
        rows["prob"] = flight(rows["size"].astype(float).tolist(), rows["prob"].tolist(), draw, last)
        return rows

    return fly


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn; they share ``share`` of all words by
    weight, none above ``most`` times its size: target = min(rate * weight, most * size) with the one
    rate at which the targets add up. Sources may be as many as hosts: they are numbered from a sort by
    range, and the rate is found by a few sums over all of them, each of which caps what is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = F.col("source").asc_nulls_last()
    per = per.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id())
    per = staged(per.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}), "mix-sources")
    # one row for each part of the sort: the only window
    before = per.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("place") + F.col("before"), F.lit(len(weights))) + 1
    per = per.join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(most))
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    rate, above = 0.0, -1
    while True:
        over = F.col("most") < F.lit(rate) * F.col("weight")
        n, capped, rest = per.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == above or not rest:
            break
        rate, above = (total - capped) / rest, n
    return per.select("source", "source_size", "n_docs", F.least(F.lit(float(rate)) * F.col("weight"), "most").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = CHUNK, row: str | None = None) -> DataFrame:
    """doc_id, n, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, text, source).

    size is the number of words (null text: 0; texts of any length are counted whole), copies how often
    the mix takes the document, taken = copies * size; ``n`` is the long column named by ``row`` (to tell
    rows of one doc_id apart), else 0. A null source is a source of its own, the last one. Rows
    without a doc_id are left out; repeated rows (ties) are documents like others; documents without words
    are taken or not like others; an empty table gives an empty result; extra columns, whatever their
    names, are ignored.
    """
    n = (F.col(row) if row else F.lit(0)).cast("long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staged(sizes.where("doc_id is not null"), "mix-sizes")
    targets = staged(source_targets(sizes, weights, share, most), "mix-targets")
    t = targets.withColumnRenamed("source", "of")
    # one source may hold a third of all rows: the adaptive planner splits this join's large partitions
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["of"])).drop("of")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("times", times).withColumn("base", F.floor(F.col("times") + 1e-9)).withColumn("prob", F.greatest(F.col("times") - F.col("base"), F.lit(0.0)))
    columns = ["doc_id", "n", "source", "size", "source_size", "target", "base", "prob", "n_docs"]
    schema = "doc_id long, n long, source string, size long, source_size long, target double, base long, prob double, n_docs long"
    rows = rows.select(*columns)
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    done, level = None, 0
    while True:
        last = most_docs <= chunk
        chunks = F.greatest(F.ceil(F.col("n_docs") / F.lit(chunk)), F.lit(1))
        key = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("doc_id", F.lit(level)), chunks)
        flown = staged(rows.withColumn("chunk", key).groupBy("source", "chunk").applyInPandas(_fly(level, last), schema + ", chunk long").drop("chunk"), f"mix-flight{level}")
        settled = flown if last else flown.where("prob <= 0 or prob >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        # a chunk leaves two open at most, so a source's open documents are 2 for each of its chunks
        rows = flown.where("prob > 0 and prob < 1").withColumn("n_docs", F.ceil(F.col("n_docs") / F.lit(chunk)) * 2)
        most_docs, level = -(-most_docs // chunk) * 2, level + 1
    copies = (F.col("base") + F.round("prob")).cast("long")
    return done.select("doc_id", "n", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
