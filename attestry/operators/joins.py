"""Joins and rankings that several stages share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is sent to every task; beyond, Spark chooses, by exchanging both sides if need be.
SENT_ROWS, SENT_BYTES = 500_000, 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    sizes = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.octet_length(F.coalesce(F.to_json(F.struct(c)), F.lit(""))))
    return sum(sizes, F.lit(24 * len(df.columns)))


def small(df: DataFrame, rows: int = SENT_ROWS, size: int = SENT_BYTES) -> DataFrame:
    """``df``, marked to be sent to every task if it has at most so many rows and bytes (counted by a bounded scan)."""
    told = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if told["n"] <= rows and told["b"] <= size else df


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; the order must be total.  Spark prunes each task's groups before it exchanges them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Every row of a group with its place: for groups that are few rows by nature, such as a claim's leads; the order must be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per_key(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One row of every group, the one whose ``order`` is smallest, by partial aggregation rather than a sort."""
    others = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("first"))
    return best.select(*by, *[F.col("first")[c].alias(c) for c in others])


def interleave(lists: DataFrame, by: list[str], which: str, place: str, key: str) -> DataFrame:
    """Ranked lists taken in turn (place by place, list by list within a place), each key once, renumbered from 1 in ``turn``."""
    once = first_per_key(lists, [*by, key], F.struct(place, which))
    return once.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(place, which)))


def until_enough(hits: DataFrame, by: list[str], tier: str, key: str, enough: int) -> DataFrame:
    """Hits of the tiers up to the first at which ``enough`` distinct keys have been found; later tiers are not asked."""
    fresh = hits.groupBy(*by, key).agg(F.min(tier).alias(tier)).groupBy(*by, tier).agg(F.count("*").alias("fresh"))
    asked = hits.select(*by, tier).distinct().join(fresh, [*by, tier], "left")
    earlier = Window.partitionBy(*by).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)
    open_tiers = asked.withColumn("before", F.coalesce(F.sum(F.coalesce("fresh", F.lit(0))).over(earlier), F.lit(0))).where(F.col("before") < enough)
    return hits.join(open_tiers.select(*by, tier), [*by, tier], "left_semi")


def within_budget(parts: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Parts in order as long as their sizes add up to at most ``budget``; a group's first part always stays."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The first part that goes past the budget ends the group, whatever comes after it.
    past = F.max((so_far > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("so_far", so_far).withColumn("past", past).withColumn("nth", F.row_number().over(w)).where((F.col("past") == 0) | (F.col("nth") == 1)).drop("past", "nth")


def alias_chain(names: DataFrame, aliases: DataFrame, name: str, hops: int = 4) -> DataFrame:
    """``names`` with resolved: where following ``aliases`` (source, target) at most ``hops`` times leads."""
    out = names.withColumn("resolved", F.col(name))
    step = small(aliases.select(F.col("source").alias("from_name"), F.col("target").alias("to_name")))
    for _ in range(hops):
        out = out.join(step, F.col("resolved") == F.col("from_name"), "left").withColumn("resolved", F.coalesce("to_name", "resolved")).drop("from_name", "to_name")
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names, for what several later steps read.

    It is written as compressed columns, of which a step reads those that it needs; the shuffle files of the plan go, as the table stands for it.
    A task that reads it unpacks thousands of rows of a column at once, but only of one group: very wide rows come in groups of ``rows``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attestry-")
        sc.setCheckpointDir(folder)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(compression="zstd", **({"parquet.block.row.count.limit": rows} if rows else {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
