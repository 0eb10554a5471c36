"""Connected components of a distributed edge list, by alternating large and small stars.

Only DataFrame operations.  A star's centre may touch a third of all edges: its minimum is a partially aggregated
sum-like value, and the join that hands it back reads two written tables, so that Spark can split the centre's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import released, written

#: Edges to a task: few edges need few tasks, however many partitions an exchange has.
EDGES = 25_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every node of ``edges`` (columns ``a`` and ``b``, any orderable type) its component's smallest.

    Loops and repeated edges are harmless; rows with a null end are no edges; no edges give no rows.
    """
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _mark(e)
    while before[0]:
        last, tasks = e, 8 + before[0] // EDGES
        cut = lambda df: written(df.coalesce(tasks))  # noqa: E731, B023
        # Large star: a node's larger neighbours move to its smallest neighbour.
        ends = e.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        least = cut(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")))
        large = cut(e.join(least, e["lo"] == least["node"]).select("hi", F.col("least").alias("lo")).distinct())
        # Small star: a node's smaller neighbours, and itself, move to the smallest of them.
        smallest = cut(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))
        moved = large.join(smallest, large["hi"] == smallest["node"]).where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        e = cut(moved.unionByName(smallest.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct())
        after = _mark(e)
        done = after == before and e.exceptAll(last).isEmpty()
        released(last, least, large, smallest)
        if done:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _mark(e: DataFrame) -> tuple[int, int]:
    """How many edges, and a sum that tells most edge sets apart: where it repeats, the sets themselves are compared."""
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]
