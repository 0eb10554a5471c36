"""Streams of calls: how many fell within the last minute, and what has not expired.

The same functions serve batch tables (exact, by range windows) and streams (by sliding windows with a watermark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_calls(calls: DataFrame, by: list[str], ts: str, seconds: int = 60, most: int = 18) -> DataFrame:
    """Calls with recent (calls of the group in the last ``seconds``, this one included) and allowed (at most ``most``)."""
    span, micros = seconds * 1_000_000, F.unix_micros(F.col(ts).cast("timestamp"))
    # A stretch of time is looked at with the one before it, so that a busy group's calls are spread over many tasks.
    own = F.floor(micros / span)
    dealt = calls.select(F.struct(*calls.columns).alias("call"), *by, micros.alias("at"), F.explode(F.array(own, own + 1)).alias("stretch"), own.alias("own"))
    w = Window.partitionBy(*by, "stretch").orderBy("at").rangeBetween(-span, 0)
    counted = dealt.withColumn("recent", F.count("*").over(w)).where(F.col("stretch") == F.col("own"))
    return counted.select("call.*", "recent", (F.col("recent") <= most).alias("allowed"))


def unexpired(flags: DataFrame, by: list[str], ts: str, now: str, hours: int) -> DataFrame:
    """The groups whose latest flag is less than ``hours`` old at ``now`` (a timestamp literal)."""
    latest = flags.groupBy(*by).agg(F.max(ts).alias("flagged"))
    return latest.where(F.col("flagged") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {hours} HOURS"))


def windowed_calls(stream: DataFrame, by: list[str], ts: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Calls per group and sliding window of a stream; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(*by, F.window(ts, window, slide)).agg(F.count("*").alias("calls"))


def first_seen(stream: DataFrame, keys: list[str], ts: str, keep: str = "10 minutes") -> DataFrame:
    """Each key's first event within ``keep``; the state of older keys is dropped."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(keys)
