"""Tables that cut a plan, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.spread import marked

#: Rows of one or two numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Ids of documents that may be broadcast as rows, which cost the driver some 75 bytes each and as much again
#: while they are sent; more are broadcast as bits (`marked`).
ID_ROWS = 100_000
#: Texts of one Arrow batch.
BATCH_ROWS = 1_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="llm-")
    return _own[key]


def stage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so that lost executors cost a re-read."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of a few numbers per row, marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= rows else df


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of df that are not among those of `gone`, a staged frame of some of its columns. Beyond
    ID_ROWS only rows that bits cannot tell from them are shuffled."""
    on = gone.columns
    if gone.count() <= ID_ROWS:
        return df.join(F.broadcast(gone), on, "left_anti")
    rows = marked(df, on, gone, "_gone")
    rest = rows.where("_gone").drop("_gone").join(gone, on, "left_anti").select(*df.columns)
    return rows.where("not _gone").drop("_gone").unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), to be read in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node hands the smallest of its neighbours and itself to its larger (or smaller) ones."""
    if larger:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    linked = near.join(least, "a")
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id that has one.

    Alternates large and small stars until the edges stay the same; each round is one table in
    the shared folder. Edges always run from the larger to the smaller id.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"),
                                               F.least("a", "b").alias("b")).distinct())
    mark = None
    while not edges.isEmpty():
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
        edges = stage(_stars(_stars(edges, larger=True), larger=False))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
