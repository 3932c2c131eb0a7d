"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, scratch

#: Rows of a task, about.
TASK_ROWS = 500_000


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffles of what runs inside have a partition for TASK_ROWS rows, at least as many as set; gives their number."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    tasks = max(int(was), -(-rows // TASK_ROWS))
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        yield tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def _mix(x: Column) -> Column:
    """A bijection of 64-bit integers (xorshift), so that key order is random."""
    for left, right in ((13, 7), (21, 9)):
        x = x.bitwiseXOR(F.shiftleft(x, left))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
    return x


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list of bigint ids.

    Returns (node, component), one row per node that has an edge; component
    is the smallest id in the node's component. Null ends and loops are
    ignored, repeated edges do no harm, an empty list gives an empty result.

    Randomised contraction: every node adopts the smallest of itself and its
    neighbours under a random order, the edges are rewritten to the adopted
    nodes and made distinct, and so on until no edge is left. The expected
    number of nodes falls by a constant factor in each round. Hot nodes only
    meet partial aggregates and joins that can be split.
    """
    with scratch() as keep:
        e = edges.select(_mix(F.col(a)).alias("u"), _mix(F.col(b)).alias("v"), F.col(a).alias("ia"), F.col(b).alias("ib"))
        e = e.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        nodes = e.select(F.col("u").alias("n"), F.col("ia").alias("id")).union(e.select("v", "ib"))
        nodes = cut(nodes.distinct(), "nodes")
        e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        parents = []
        while not e.isEmpty():
            both = e.union(e.select("v", "u"))
            p = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).withColumnRenamed("u", "n"), "parents")
            parents.append(p)
            up, vp = p.select(F.col("n").alias("u"), F.col("p").alias("pu")), p.select(F.col("n").alias("v"), F.col("p").alias("pv"))
            e = e.join(up, "u").join(vp, "v").filter("pu <> pv")
            e = cut(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        out = nodes.withColumn("root", F.col("n"))
        for p in parents:
            out = out.join(p.select(F.col("n").alias("root"), "p"), "root", "left").select("n", "id", F.coalesce("p", "root").alias("root"))
        out = keep(cut(out.select("id", "root"), "roots"))
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return out.join(least, "root").select(F.col("id").alias("node"), "component")
