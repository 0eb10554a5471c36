"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: how its share of the mix changes while training time goes from 0 to 1, as straight lines between knots.
A source's target is its weight's part of what the mix holds, with a limit on repeats; what limited sources leave goes to the others by
weight.  Its documents stand in a fixed random order, repeated pass after pass, until its target is met.  The schedule's integral says how much
of the target is due by a time; its inverse gives every pass of a document the time at which its words are due, and documents are sorted by it.

DataFrame functions only.  Prefix sums go in two steps, over slices of a source's order and inside each slice, so that no task
holds a source; only ids, hashes and sizes are exchanged, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SENT_BYTES, table, written

#: Documents of a slice, about; and times that a document may be used.
SLICE, REPEATS = 2_000, 2
#: Bytes of a source's row, about.
SOURCE_ROW = 512
#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"

_KNOTS = "array<struct<at: double, level: double>>"


def straight(first: float | Column, last: float | Column) -> Column:
    """A schedule that goes from the level ``first`` at time 0 to ``last`` at time 1."""
    knot = lambda at, level: F.struct(F.lit(at).cast("double").alias("at"), (F.lit(level) if not isinstance(level, Column) else level).cast("double").alias("level"))
    return F.array(knot(0.0, first), knot(1.0, last))


def integrated(knots: Column) -> Column:
    """The knots of a schedule, each with the schedule's integral up to it (field ``sum``)."""

    def step(done: Column, k: Column) -> Column:
        last = F.element_at(done, -1)
        area = (k["at"] - last["at"]) * (k["level"] + last["level"]) / 2
        return F.concat(done, F.array(F.struct(k["at"].alias("at"), k["level"].alias("level"), (last["sum"] + area).alias("sum"))))

    zero = F.struct(knots[0]["at"].alias("at"), knots[0]["level"].alias("level"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.slice(knots, 2, F.greatest(F.size(knots) - 1, F.lit(0))), F.array(zero), step)


def due(sums: Column, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of the whole integral is reached; ``sums`` come from ``integrated``."""
    wanted = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.element_at(sums, -1)["sum"]

    def solved(k: Column, wanted: Column) -> Column:
        # Inside a segment the integral is level * x + slope * x * x / 2.
        a, b = sums[k], sums[F.least(k + 1, F.size(sums) - 1)]
        rest, width = F.greatest(wanted - a["sum"], F.lit(0.0)), b["at"] - a["at"]
        slope = F.coalesce(F.try_divide(b["level"] - a["level"], width), F.lit(0.0))
        root = a["level"] + F.sqrt(F.greatest(a["level"] * a["level"] + 2 * slope * rest, F.lit(0.0)))
        return F.when(rest <= 0, a["at"]).otherwise(F.least(a["at"] + F.coalesce(F.try_divide(2 * rest, root), width), b["at"]))

    # The last knot before the wanted sum, but for the very last one.
    before = lambda w: F.greatest(F.size(F.filter(sums, lambda s: s["sum"] < w)) - 1, F.lit(0))
    return F.transform(F.array(wanted), lambda w: solved(before(w), w))[0]


def sources(sized: DataFrame, weight: Column, schedule: Column, share: float = 1.5, repeats: int = REPEATS) -> DataFrame:
    """source, source_rank, source_size, weight, target and sums for every source of ``sized`` (source, size).

    ``weight`` and ``schedule`` may use source, source_rank (from 0, by code point, null last) and source_size.  Targets share ``share`` of all sizes by
    weight and stop at ``repeats`` times the source's size; what is over goes to those below, by weight, until none is above.  Sources
    are rows of a small table: their ranking is one task's, of one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    told = totals.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    told = told.withColumn("most", F.when(F.col("weight") > 0, F.col("source_size") * repeats).otherwise(0).cast("double"))
    told = told.withColumn("ratio", F.when(F.col("weight") > 0, F.try_divide("most", "weight")).otherwise(0.0))
    # In order of most / weight, those that end at their most come first: the first whose most is not below its part of what
    # is then left, shared by weight, sets the level for itself and all after it.
    upto = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - (F.sum("most").over(upto) - F.col("most"))
    told = told.withColumn("level", F.try_divide(left, F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_rank", "level"))).over(whole)
    told = told.withColumn("target", F.coalesce(F.least(F.col("most"), F.col("weight") * first["level"]), F.col("most")))
    return told.select("source", "source_rank", "source_size", "n", "weight", "target", integrated(schedule.cast(_KNOTS)).alias("sums"))


def mixed(
    docs: DataFrame, weight: Column, schedule: Column, share: float = 1.5, repeats: int = REPEATS, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_of_slice: int = SLICE,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes of every row of ``docs``, sorted by the time of its first pass.

    ``size`` is the number of words, ``taken`` how many of them the mix takes, repeats counted, and ``passes`` an array of (pass, at, words): the
    times, from 0 to 1, at which the document is due, and how many of its words then.  A source's words in order, pass after pass, end
    at its target rounded to a whole number, inside a document if need be, so that only its last document is ever taken in part.

    A null or empty text has size 0 and is never taken; a null source is a source; null ids are ordered by text alone.  Repeated rows are documents
    each, of which one may be taken once more than the other.  Very long texts count whole.  An empty table gives no rows; other
    columns are not read.  The order depends on seed, ids and texts alone, so that reruns agree.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
    )
    sized = written(sized)
    told = written(sources(sized, weight, schedule, share, repeats))
    few = told.count() * SOURCE_ROW <= SENT_BYTES
    rows = sized.alias("d").join((F.broadcast(told) if few else told).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("d.*", "s.source_rank", "s.source_size", "s.n", "s.target", "s.sums")
    # A slice is a range of a source's hashes, so that the slices' order and the order inside them make one.
    slices = F.greatest(F.ceil(F.col("n") / F.lit(rows_of_slice)), F.lit(1)).cast("long")
    part = F.least(F.floor(F.shiftrightunsigned("key", 24) * (slices / F.lit(float(1 << 40)))), slices - 1)
    rows = rows.withColumn("slice", part)
    sums = rows.groupBy("source_rank", "slice").agg(F.sum("size").alias("in_slice"))
    ahead = Window.partitionBy("source_rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_rank", "slice", F.coalesce(F.sum("in_slice").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_rank", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source_rank", "slice"])
    start = F.col("before") + F.col("upto") - F.col("size")
    whole = F.round("target").cast("long")
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda p: F.transform(
            F.array((start + p * F.col("source_size")).cast("long")),
            lambda first: F.struct(
                p.cast("int").alias("pass"),
                # Due when half of the words are.
                due(F.col("sums"), F.try_divide(first + F.least(F.col("size"), whole - first) / 2, F.col("target"))).alias("at"),
                F.greatest(F.least(F.col("size"), whole - first), F.lit(0)).cast("long").alias("words"),
            ),
        )[0],
    )
    out = rows.withColumn("passes", F.filter(F.when(F.col("size") > 0, passes).otherwise(F.array().cast("array<struct<pass:int,at:double,words:bigint>>")), lambda x: x["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "key")
    return out.orderBy(F.asc_nulls_last(F.get("passes", F.lit(0))["at"]), "key", "doc_id").drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("source_rank") % 3
    weight = F.when(rank == 0, 3).when(rank == 1, 1).otherwise(2)
    # Sources of every other rank start at half their mean level and end at one and a half of it; the others go the other way.
    rising = F.when(F.col("source_rank") % 2 == 0, 0.5).otherwise(1.5)
    out = mixed(table(spark, sf_dir, "documents"), weight, straight(rising, 2 - rising))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["at"].alias("first_at"), F.size("passes").alias("n_passes"))
