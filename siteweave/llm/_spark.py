"""Spark helpers of the text operators: batch sizes and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most BATCH_ROWS rows and BATCH_BYTES at once, unless the session asks for fewer.

    A batch is held by the JVM, by the worker and in the worker's results, so
    its size bounds an executor's memory beside the heap, however long the
    texts of a group are.  A single longer row is a batch of its own.
    """
    if int(spark.conf.get(BATCH_KEY, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    asked = spark.conf.get(BYTES_KEY, "64m").removesuffix("b")
    if not (asked.isdigit() and 0 < int(asked) <= BATCH_BYTES):
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("a").cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["a"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: (node, component).

    Alternates large-star and small-star contraction (Kiveris et al. 2014).
    Each half step is a mergeable minimum per node and one equi-join, so a hub
    never has to fit in one task; rounds are logarithmic in practice.  An edge
    table without rows gives no rows; loops and repeats are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written, so that both sides of the joins are plain exchanges and a hub's rows can be split
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # every b > a now hangs on the smallest neighbour; then each node's smaller neighbours do
        low = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = written(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    inner = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return inner.unionByName(roots)
