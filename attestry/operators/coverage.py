"""Weighted token coverage of claims by texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .joins import small


def claim_tokens(claims: DataFrame, claim_id: str, text: str, background: Column | None = None) -> DataFrame:
    """claim_id, token, weight in hundredths (so that sums are exact): the largest weight of a token's forms."""
    parts = claims.select(claim_id, F.explode(C.weighted_tokens(F.col(text), background)).alias("t"))
    return parts.groupBy(claim_id, F.col("t.token").alias("token")).agg(F.max(F.round(F.col("t.weight") * 100)).cast("long").alias("weight"))


def coverage(tokens: DataFrame, targets: DataFrame, claim_id: str, target_id: str, text: str) -> DataFrame:
    """claim_id, target_id, matched, total for every pair that shares a token.

    ``tokens`` come from ``claim_tokens``.  Only the claims' vocabulary is looked up in a text, and a text's matches are summed where it was
    read before anything is exchanged.
    """
    words = targets.select(target_id, F.explode(C.tokens(F.col(text))).alias("token"))
    matched = words.join(small(tokens), "token").groupBy(claim_id, target_id).agg(F.sum("weight").alias("matched"))
    totals = tokens.groupBy(claim_id).agg(F.sum("weight").alias("total"))
    return matched.join(small(totals), claim_id)


def common_tokens(texts: DataFrame, text: str, share: float) -> DataFrame:
    """Tokens that more than ``share`` of the texts have: they tell none apart."""
    n = texts.count()
    return texts.select(F.explode(C.tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > share * n).select("token")


def multiset_overlap(a: DataFrame, b: DataFrame, key: str, words_a: Column, words_b: Column) -> DataFrame:
    """key, overlap, n_a, n_b, f1: the shared words of two texts of one key, each as often as both have it."""
    count = lambda df, w, name: df.select(key, F.explode(w).alias("word")).groupBy(key, "word").agg(F.count("*").alias(name))
    both = count(a, words_a, "x").join(count(b, words_b, "y"), [key, "word"], "full")
    sums = both.groupBy(key).agg(
        F.sum(F.coalesce(F.least("x", "y") * (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int"), F.lit(0))).alias("overlap"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("n_b"),
    )
    return sums.withColumn("f1", F.when(F.col("n_a") + F.col("n_b") > 0, 2 * F.col("overlap") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0))
