"""Record deduplication: exact keys, near-equal titles by matching segments, and a pass in order against records that stay.

Decisions are made for distinct (DOI, PMID, title) triples: of records with equal keys only the first can stay.
Two rounds settle those that come first by all their keys and all that share a key with these, so keys that many hold
are used up; what keys or near titles still connect are components, each small one gone through in order by one task, a
large one in more rounds. Holders of keys are at most one row a key, so all records find theirs by joins that the
adaptive planner can split. ``RecordIndex`` keeps the keys and title segments of records that stay, so that a
search round is compared with what is held without a rerun.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import indel_ratio
from ..functions.text import doi_key, pmid_key, title_key
from ..session import landed, scratch

#: Triples of a component that one task goes through; larger components take rounds.
COMPONENT = 5_000
THRESHOLD = 0.95


def keyed(records: DataFrame) -> DataFrame:
    """Records with normalised keys; columns that a source lacks count as null."""
    def col(name: str):
        return F.col(name) if name in records.columns else F.lit(None).cast("string")

    return records.withColumns({"doi_key": doi_key(col("doi")), "pmid_key": pmid_key(col("pmid")), "title_key": title_key(col("title"))})


def exact(records: DataFrame, key: str, order: str) -> DataFrame:
    """order, kept_order: each record and the first one with the same key; null keys are no duplicates."""
    first = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("kept"))
    return records.select(order, key).join(first, key, "left").select(order, F.coalesce("kept", order).alias("kept"))


def _edits(n: Column, threshold: float) -> Column:
    """Insertions and deletions between a title of n characters and the longest that can be near it."""
    return F.floor(2 * n * ((1 - threshold) / threshold) + 1e-9).cast("int")


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Place and length of the i-th (from 0) of so many even parts of n characters; the last ones are a character longer."""
    base, longer = F.floor(n / parts).cast("int"), parts - F.pmod(n, parts)
    return i * base + F.greatest(F.lit(0), i - longer), base + F.when(i >= longer, 1).otherwise(0)


def title_segments(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """n, part, segment, title_key: one more part than there can be edits, so one is in every near title unchanged."""
    rows = titles.select("title_key", F.length("title_key").alias("n")).withColumn("parts", _edits(F.col("n"), threshold) + 1).where("parts > 1")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place, size = _segment(F.col("n"), F.col("parts"), F.col("part"))
    return rows.select("n", "part", F.substring("title_key", place + 1, size).alias("segment"), "title_key")


def title_probes(titles: DataFrame, threshold: float = THRESHOLD, longer: bool = True) -> DataFrame:
    """n, part, segment, title_key: where a title may hold a part of another title of n characters.

    A part is where the edits before and behind it allow: if it is the first to agree from the left, as many places
    away at most as there are parts before it, and likewise from the right. ``longer``: also for others longer than it.
    """
    m = F.length("title_key")
    ratio = threshold / (2 - threshold)
    low, high = F.ceil(m * ratio - 1e-9).cast("int"), F.floor(m / ratio + 1e-9).cast("int") if longer else m
    rows = titles.select("title_key", m.alias("m"), F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))).alias("n"))
    rows = rows.withColumn("parts", _edits(F.col("n"), threshold) + 1).withColumn("d", F.floor((1 - threshold) * (F.col("n") + F.col("m")) + 1e-9).cast("int")).where("parts > 1 and abs(m - n) <= d")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place, size = _segment(F.col("n"), F.col("parts"), F.col("part"))
    rows = rows.withColumns({"place": place, "size": size, "more": F.col("m") - F.col("n")})
    after = F.col("parts") - 1 - F.col("part")
    first = F.greatest(F.lit(0), F.col("place") - F.col("part"), F.col("place") + F.col("more") - after, F.col("place") - F.floor((F.col("d") - F.col("more")) / 2).cast("int"))
    last = F.least(F.col("m") - F.col("size"), F.col("place") + F.col("part"), F.col("place") + F.col("more") + after, F.col("place") + F.floor((F.col("d") + F.col("more")) / 2).cast("int"))
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    return rows.select("n", "part", F.substring("title_key", F.col("at") + 1, F.col("size")).alias("segment"), "title_key")


def near_titles(probes: DataFrame, segments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """x, y: each pair of different titles, once, whose indel ratio reaches the threshold; complete over both sides."""
    a, b = probes.withColumnRenamed("title_key", "p"), segments.withColumnRenamed("title_key", "q")
    # many segments a title: the planner sees the titles' size only and would send them all through the driver
    pairs = a.join(b.hint("merge"), ["n", "part", "segment"]).where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    # unit-cost edits are never more than insertions and deletions: a bound that stays in the JVM, before any shuffle of pairs
    limit = F.floor((1 - threshold) * (F.length("x") + F.length("y")) + 1e-9)
    pairs = pairs.where(F.abs(F.length("x") - F.length("y")) <= limit).where(F.levenshtein("x", "y") <= limit).distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", ratio("x", "y")).where(F.col("ratio") >= threshold).select("x", "y", "ratio")


def similar_titles(records: DataFrame, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """u, v, ratio: pairs (earlier, later) of different titles whose indel ratio reaches the threshold; titles are named by their first record."""
    titles = landed(records.where(F.length("title_key") > 0).groupBy("title_key").agg(F.min(order).alias("at")), "dedup-titles")
    pairs = near_titles(title_probes(titles, threshold, longer=False), title_segments(titles, threshold), threshold)
    named = pairs.join(titles.select(F.col("title_key").alias("x"), F.col("at").alias("a")), "x").join(titles.select(F.col("title_key").alias("y"), F.col("at").alias("b")), "y")
    return named.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "ratio")


def components(edges: DataFrame) -> DataFrame:
    """node, component: connected components of (u, v) edges, named by one of their nodes.

    In each round every node joins the one of itself and its neighbours that comes first by a hash, anew for each
    round, so that even a chain in order of its numbers shrinks by a share each time; the edges between what they
    joined remain. Then all is followed back.
    """
    left, parents = landed(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components-edges"), []
    while not left.isEmpty():
        def first(c: str, salt=len(parents)) -> Column:
            return F.struct(F.xxhash64(c, F.lit(salt)), F.col(c).alias("node"))

        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min(first("v")).alias("best")).select(F.col("u").alias("node"), F.least("best", first("u"))["node"].alias("parent"))
        parents.append(landed(parent, "components-parents"))
        moved = left.join(parents[-1].toDF("u", "pu"), "u").join(parents[-1].toDF("v", "pv"), "v").where("pu <> pv")
        left = landed(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "components-edges")
    if not parents:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    top = parents[-1].withColumnRenamed("parent", "component")
    for parent in reversed(parents[:-1]):
        top = landed(parent.join(top.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component")), "components")
    return top


#: A record's keys in the order in which they decide, and what tells them apart.
KEYS = (("doi_key", "d:"), ("pmid_key", "p:"), ("title_key", "t:"))


def _near_sides(near: DataFrame) -> DataFrame:
    """title_key, other: each pair of near titles from both sides."""
    return near.select(F.col("x").alias("title_key"), F.col("y").alias("other")).unionByName(near.select(F.col("y").alias("title_key"), F.col("x").alias("other")))


def settle(triples: DataFrame, near: DataFrame | None, order: str) -> tuple[DataFrame, DataFrame]:
    """Triples that stay because they come first by all their keys and near titles, and those that share none with them.

    Near titles are joined title by title, so that a title of many triples counts once.
    """
    out, at = triples, F.col(order)
    for name, _ in KEYS:
        leads = triples.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias(f"__{name}"))
        if name == "title_key" and near is not None:
            around = _near_sides(near).join(leads.withColumnRenamed(name, "other"), "other").groupBy(name).agg(F.min(f"__{name}").alias("__near"))
            leads = leads.join(around, name, "left").select(name, F.least(f"__{name}", "__near").alias(f"__{name}"))
        out = out.join(landed(leads, "dedup-lead"), name, "left")  # written: a hot key's triples can then be split
    firm = landed(out.where(" and ".join(f"(__{n} is null or __{n} >= {order})" for n, _ in KEYS)).select(triples.columns), "dedup-firm")
    left = triples
    for name, _ in KEYS:
        held = firm.where(F.col(name).isNotNull()).select(name)
        if name == "title_key" and near is not None:
            held = held.unionByName(_near_sides(near).join(held.withColumnRenamed(name, "other"), "other").select(name)).distinct()
        left = left.join(held, name, "left_anti")
    return firm.select(at), landed(left.select(triples.columns), "dedup-left")


def decide(triples: DataFrame, near: DataFrame | None, order: str, component: int = COMPONENT, rounds: int = 2) -> DataFrame:
    """The triples (order, doi_key, pmid_key, title_key) that stay; ``near`` has pairs (x, y) of titles.

    A few rounds of ``settle`` first: a key that many hold is then used up. What is left falls into components.
    """
    stay, left = triples.select(order).limit(0), triples
    for _ in range(rounds):
        firm, left = settle(left, near, order)
        stay = stay.unionByName(firm)
        if left.isEmpty():
            return stay
    triples = left
    names = F.array(*[F.concat(F.lit(sign), F.col(name)) for name, sign in KEYS])
    keys = triples.select(order, F.explode(F.filter(names, lambda k: k.isNotNull())).alias("key"))
    leads = landed(keys.groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("n")), "dedup-leads")
    edges = keys.join(leads.where("n > 1"), "key").select(F.col(order).alias("u"), F.col("lead").alias("v"))
    if near is not None:
        titles = leads.where(F.col("key").startswith("t:"))
        a, b = (titles.select(F.expr("substring(key, 3)").alias(c), F.col("lead").alias(n)) for c, n in (("x", "u"), ("y", "v")))
        edges = edges.unionByName(near.join(a, "x").join(b, "y").select("u", "v"))
    found = components(edges)
    sizes = landed(found.groupBy("component").agg(F.count("*").alias("n")), "dedup-sizes")
    alone = triples.join(found.select(F.col("node").alias(order)), order, "left_anti").select(order)
    placed = landed(triples.join(found.withColumnRenamed("node", order), order).join(sizes, "component"), "dedup-placed")
    small, kind = placed.where(F.col("n") <= component), dict(triples.dtypes)[order]
    pairs = small.select("component", F.col("title_key").alias("x")).where("x is not null").distinct()
    pairs = pairs.withColumn("y", F.lit(None).cast("string")).limit(0) if near is None else near.select("x", "y").join(pairs, "x").select("component", "x", "y")
    pairs = landed(pairs, "dedup-placed-near")

    def in_order(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        others: dict[str, list[str]] = {}
        for x, y in zip(pairs["x"], pairs["y"], strict=True):
            others.setdefault(x, []).append(y)
            others.setdefault(y, []).append(x)
        held, stay = set(), []
        for at, *own in rows.sort_values(order)[[order, *(k for k, _ in KEYS)]].itertuples(index=False):
            own = [(i, k) for i, k in enumerate(own) if isinstance(k, str)]
            if not any(k in held for k in own) and not any((2, y) in held for i, k in own if i == 2 for y in others.get(k, ())):
                stay.append(at)
                held.update(own)
        return pd.DataFrame({order: stay})

    stay = stay.unionByName(alone).unionByName(small.groupBy("component").cogroup(pairs.groupBy("component")).applyInPandas(in_order, f"{order} {kind}"))
    large = placed.where(F.col("n") > component).select(triples.columns)
    while not large.isEmpty():
        firm, large = settle(large, near, order)
        stay = stay.unionByName(firm)
    return stay


def _resolved(rows: DataFrame, holders: DataFrame, near: DataFrame | None, order: str) -> DataFrame:
    """order, kept: each record's holder by DOI, else PMID, else title (the earliest of equal and near ones), of those before it."""
    out = rows
    for name, _ in KEYS:
        own = holders.where(F.col(name).isNotNull()).select(name, F.col(order).alias("__h"))
        if name == "title_key" and near is not None:
            own = own.unionByName(_near_sides(near).join(own.withColumnRenamed(name, "other"), "other").select(name, "__h"))
        # written, so that the join reads one row a key from a shuffle of its own and a hot key's records can be split
        out = out.join(landed(own.groupBy(name).agg(F.min("__h").alias(f"__{name}")), "dedup-holder"), name, "left")
    at = F.col(order)
    return out.select(order, F.coalesce(*[F.when(F.col(f"__{name}") < at, F.col(f"__{name}")) for name, _ in KEYS], at).alias("kept"))


def _rows(records: DataFrame, order: str) -> DataFrame:
    """order and keys; empty identifiers are none, an empty title is one."""
    rows = keyed(records)
    return rows.select(order, *[F.nullif(F.col(n), F.lit("")).alias(n) if n != "title_key" else F.col(n) for n, _ in KEYS])


def _triples(rows: DataFrame, order: str) -> DataFrame:
    return rows.groupBy(*[n for n, _ in KEYS]).agg(F.min(order).alias(order)).where(" or ".join(f"{n} is not null" for n, _ in KEYS))


def _titles(triples: DataFrame) -> DataFrame:
    return triples.where(F.length("title_key") > 0).select("title_key").distinct()


def deduplicate(records: DataFrame, order: str, fuzzy: bool = True, component: int = COMPONENT) -> DataFrame:
    """order, kept: DOI, then PMID, then title (equal, or near with ``fuzzy``), each against records that stay only.

    A null title is none; empty titles are equal to each other.
    """
    rows = landed(_rows(records, order), "dedup-rows")
    triples, near = landed(_triples(rows, order), "dedup-triples"), None
    if fuzzy:
        titles = landed(_titles(triples), "dedup-titles")
        near = landed(near_titles(title_probes(titles, longer=False), title_segments(titles)), "dedup-near")
    holders = landed(triples.join(decide(triples, near, order, component), order), "dedup-holders")
    return _resolved(rows, holders, near, order)


class RecordIndex:
    """Records that stay, by rounds: each round's records come after all before, and are compared with those held and each other.

    Keys and title segments of the records held are tables under ``path`` (default: a fresh folder of the shared one),
    to which a round adds its own; a round that is run again replaces what it had added.
    """

    def __init__(self, spark: SparkSession, order: str, fuzzy: bool = True, path: str | None = None):
        self.spark, self.order, self.fuzzy, self.path, self.rounds = spark, order, fuzzy, path or scratch(spark, "record-index"), 0

    def _held(self, table: str) -> DataFrame | None:
        paths = [f"{self.path}/{table}-{i}" for i in range(self.rounds)]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, records: DataFrame) -> DataFrame:
        """order, kept of a round's records."""
        order = self.order
        rows = landed(_rows(records, order), "dedup-rows")
        triples, held, near = landed(_triples(rows, order), "dedup-triples"), self._held("keys"), None
        if self.fuzzy:
            titles = landed(_titles(triples), "dedup-titles")
            near = near_titles(title_probes(titles, longer=False), title_segments(titles))
            if held is not None:
                near = near.unionByName(near_titles(title_probes(titles), self._held("segments")))
            near = landed(near.distinct(), "dedup-near")
        left = triples
        if held is not None:
            gone = _resolved(triples, held, near, order).where(F.col("kept") < F.col(order)).select(order)
            left = landed(triples.join(gone, order, "left_anti"), "dedup-left")
        fresh = triples.join(decide(left, near, order), order)
        fresh.write.mode("overwrite").parquet(f"{self.path}/keys-{self.rounds}")
        if self.fuzzy:
            title_segments(_titles(self.spark.read.parquet(f"{self.path}/keys-{self.rounds}"))).write.mode("overwrite").parquet(f"{self.path}/segments-{self.rounds}")
        self.rounds += 1
        return _resolved(rows, self._held("keys"), near, order)


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of intersection and differences, and whether the sets are equal."""
    both = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), a.columns, "full")
    out = both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_only_a"), F.count_if(F.col("in_a").isNull()).alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def complete_with(fetched: DataFrame, wanted: DataFrame, key: str = "pmid") -> DataFrame:
    """Fetched records and a stub (nulls) for each wanted id that wasn't."""
    return fetched.unionByName(wanted.select(key).distinct().join(fetched.select(key), key, "left_anti"), allowMissingColumns=True)
