"""Helpers that the training-data operators share.

Conventions of every operator of this subpackage:

* only the columns an operator needs are selected on entry, so extra columns
  of the input, whatever their names, never clash with working columns;
* rows whose identifier is null cannot be named in a result and are left out;
* a null text counts as empty;
* lineage is cut with tables in the shared folder (``spark.checkpoint.dir``),
  which survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the result contracts define it: space and tab to carriage return.
WHITE = "\x20\t\n\x0b\x0c\r"
#: One word of a text, for Spark's (Java) and for Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as an URI without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        root = context.getCheckpointDir().get()
    return root.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, always with a scheme."""
    root = shared_root(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file:///"):
        full = "file://" + full[len("file:"):]
    return f"{full}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that workdir() named, once no plan reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it again: later stages neither repeat nor lose it."""
    spark = df.sparkSession
    path = path or workdir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session doesn't say: texts are long, and a batch is held by JVM and Python alike.
BATCH_ROWS = 2_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS where the session has Spark's default number of rows, set or not (any other number stays).

    A frame is planned after its operator has returned, so the setting can't be put back.
    """
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def only(docs: DataFrame, needed: dict[str, Column], chosen) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, that ``chosen`` says yes to; one pass, no join.

    ``needed`` are columns to work on, whatever ``docs`` calls its own; ``chosen`` gets their values as
    lists, in blocks of rows, and returns a list of truth values.
    """
    from .shingles import parts, release

    small_batches(docs.sparkSession)
    names = fresh(docs, *needed)
    schema, own = docs.schema, len(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for n, c in zip(names, needed.values(), strict=True)])

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            work = pa.RecordBatch.from_arrays(batch.columns[own:], names)
            mask = [yes for part in parts(work) for yes in chosen(*part)]
            yield pa.RecordBatch.from_arrays(batch.columns[:own], schema=pa.schema([batch.schema.field(i) for i in range(own)])).filter(pa.array(mask, pa.bool_()))
        release()

    return rows.mapInArrow(keep, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text (null: empty) of the rows that have an identifier."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())


def drawn(id_col: str, share: float, last: bool = False) -> Column:
    """Whether a row is among this share of all rows by a hash of its identifier, from one end of the hashes or the other."""
    if share >= 1:
        return F.lit(True)
    reach = int(share * 2.0 ** 64)
    return F.xxhash64(id_col) >= 2 ** 63 - reach if last else F.xxhash64(id_col) < reach - 2 ** 63


def slots(spark: SparkSession) -> int:
    """Number of partitions that a keyed shuffle gets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def open_fs(uri: str):
    """The pyarrow file system of an URI (local, HDFS, S3, GCS) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by contraction: (node, component), the component being its smallest node.

    ``edges`` has two long columns u and v. In each round every node takes the smallest of itself
    and its neighbours as parent, and the edges between parents remain, so the graph shrinks until
    no edge is left; the parents are then followed back. Only aggregates with map-side combine and
    joins whose skew the adaptive planner can split are used; nothing is collected. A null end drops
    the edge; self-loops and repeated edges do no harm; without edges the result is empty.
    """
    spark = edges.sparkSession
    left = staged(edges.toDF("u", "v").where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    parents: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = staged(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("parent")), f"{name}-parents")
        parents.append(parent)
        a = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = left.join(a, "u").join(b, "v").where("pu <> pv")
        left = staged(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"{name}-edges")
    if not parents:
        return spark.createDataFrame([], "node long, component long")
    top = parents[-1].select("node", F.col("parent").alias("component"))
    for parent in reversed(parents[:-1]):
        up = top.select(F.col("node").alias("parent"), "component")
        joined = parent.join(up, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
        top = joined
    return staged(top, name)
