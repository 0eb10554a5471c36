"""Checks of leads: verdicts, tiers, outcomes, rankings and per-claim status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .joins import first_per_key, numbered, small, top_k

#: Tiers in the order they are shown; hosts of documents that anyone can upload.
TIERS = ("supports", "partial", "lead", "flag")
UPLOAD_HOSTS = ("scribd.com", "issuu.com", "yumpu.com", "pdfcoffee.com", "dokumen.pub")


def checked(replies: DataFrame) -> DataFrame:
    """Replies of the checking service (verdict, support_score, comments, verified_text) as verdict rows; the quote only from verified text."""
    v = C.verdict(F.col("verdict"))
    unavailable = v == "SOURCE UNAVAILABLE"
    return (
        replies.withColumn("confidence", F.when(unavailable, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("support_score", F.lit(0.0))))))
        .withColumn("quote", F.nullif(F.trim("verified_text"), F.lit("")))
        .withColumn("reliability", F.lit("n/a"))
        .withColumn("reliability_reason", F.when(unavailable, "source unavailable").otherwise("not assessed"))
        .withColumn("comments", F.coalesce("comments", F.lit("")))
        .withColumn("verdict", v)
        .drop("verified_text", "support_score")
    )


def verified(leads: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """Every lead with its recorded verdict; one without a recording is a source that could not be read."""
    return leads.join(verdicts, on, "left").withColumns({
        "verdict": F.coalesce("verdict", F.lit("SOURCE UNAVAILABLE")), "confidence": F.coalesce("confidence", F.lit(0.0)), "reliability": F.coalesce("reliability", F.lit("n/a")),
    })


def conclusive(verdict: Column, reliability: Column) -> Column:
    return (verdict == "SUPPORTED") & (reliability != "low")


def ranked(suggestions: DataFrame, by: list[str], seq: str = "seq", by_origin: bool = True) -> DataFrame:
    """Suggestions by bucket and confidence; then, if ``by_origin``, those that some article already cites before the web's."""
    web = F.when(F.coalesce("origin", F.lit("web")) == "web", 1).otherwise(0) if by_origin else F.lit(0)
    order = [C.bucket(F.col("verdict"), F.col("reliability")), F.desc("confidence"), web, F.col(seq)]
    return suggestions.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def unresolved(claims: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """Claims that no suggestion settles: the web is searched for these only."""
    settled = suggestions.groupBy(key).agg(F.bool_or(conclusive(F.col("verdict"), F.col("reliability"))).alias("settled")).where("settled")
    return claims.join(settled, key, "left_anti")


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Candidates whose address the claim has no suggestion for yet."""
    k = lambda df: df.withColumn("__key", C.url_key(F.col("url")))
    return k(candidates).join(k(seen).select(key, "__key"), [key, "__key"], "left_anti").drop("__key")


def compared(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "‘’“”\"'`", ""), r"[^\p{L}\p{N}]+", " "))


def copies_claim(claim: Column, text: Column) -> Column:
    """The text repeats a claim of 40 characters or more word for word: it is probably a copy of the article."""
    c = compared(claim)
    return (F.length(c) >= 40) & F.contains(compared(text), c)


def copied_pairs(passages: DataFrame, claims: DataFrame, passage_id: str, claim_id: str, run: int = 5) -> DataFrame:
    """passage_id, claim_id of every ``passages`` row (passage) that contains a ``claims`` row (claim), both as ``compared`` gives them.

    A claim may begin and end inside a word; its other words stand whole in a passage that contains it.  The first ``run`` of those, or as many as there are, are
    looked up among the passages' runs of that many words, as hashes; claims of one or two words, among their runs of characters.  Only the pairs found are compared.
    """
    c = claims.withColumn("inner", F.split("claim", " ")).withColumn("inner", F.slice("inner", 2, F.greatest(F.size("inner") - 2, F.lit(0))))
    c = c.withColumn("n", F.least(F.size("inner"), F.lit(run)))
    found = None
    for n in sorted(r["n"] for r in c.select("n").distinct().collect()):  # at most run + 1 numbers
        units, size = (F.split("passage", " "), n) if n else (F.split("passage", ""), 20)
        part = F.col("inner") if n else F.split("claim", "")
        # By places: a slice would go through the whole array for each of them.
        key = lambda xs, at, size: F.xxhash64(*[F.get(xs, at - 1 + j) for j in range(size)])
        keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size("units") - size + 1, F.lit(1))), lambda i: key(F.col("units"), i, size))  # noqa: B023
        runs = passages.select(passage_id, units.alias("units")).select(passage_id, F.explode(F.array_distinct(keys)).alias("run"))
        wanted = c.where(F.col("n") == n).select(claim_id, key(part, F.lit(1), size).alias("run"))
        pairs = runs.join(small(wanted), "run").select(passage_id, claim_id)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return passages.join(claims, F.lit(False)).select(passage_id, claim_id)
    pairs = found.distinct().join(small(claims.select(claim_id, "claim")), claim_id)
    return passages.join(pairs, passage_id).where(F.contains("passage", "claim")).select(passage_id, claim_id)


def web_tier(verdict: Column, claim: Column, comments: Column) -> Column:
    """Tier of a web source; null: it does not state the claim."""
    tier = F.when(verdict == "SUPPORTED", "supports").when(verdict == "PARTIALLY SUPPORTED", "partial")
    return F.when(tier.isNotNull() & F.coalesce(copies_claim(claim, comments), F.lit(False)), "flag").when(tier.isNotNull(), tier).when(verdict == "SOURCE UNAVAILABLE", "lead")


def warnings(url: Column, reliability: Column, tier: Column) -> Column:
    found = F.array(
        F.when(tier == "flag", "repeats the article"), F.when(C.under_domains(C.host(url), UPLOAD_HOSTS), "anyone can upload there"), F.when(reliability == "low", "reliability low")
    )
    return F.filter(found, lambda w: w.isNotNull())


def book_tier(verdict: Column) -> Column:
    return F.when(verdict.isin("supports", "partial"), verdict).when(verdict.isNull(), "lead")


def sister_outcome(check_done: Column, fact: Column, read: Column, truncated: Column) -> Column:
    """Where an other-language lead stands: by the check that it is cited for the same fact, then by its source."""
    return (
        F.when(~check_done, "unchecked")
        .when(fact.isNull(), "none")
        .when(fact == "no", "other")
        .when(read.isin("supports", "partial"), read)
        .when((read == "unsupported") & ~F.coalesce(truncated, F.lit(False)), "unsupported")
        .when(fact == "partial", "part")
        .otherwise("same")
    )


def sister_tier(outcome: Column) -> Column:
    return F.when(outcome.isin("supports", "partial"), outcome).when(~outcome.isin("other", "unsupported"), "lead")


def collected(items: DataFrame, key: str) -> DataFrame:
    """Items (key, stage, seq, tier, url, ...) to show: by tier, then search and sequence; an address once, under its best tier."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    shown = items.where(F.col("tier").isNotNull()).withColumn("tier_place", place)
    shown = shown.withColumn("item_key", F.coalesce(C.url_key(F.col("url")), F.concat_ws(":", "stage", "seq")))
    once = first_per_key(shown, [key, "item_key"], F.struct("tier_place", "stage", "seq"))
    return numbered(once, [key], [F.col("tier_place"), F.col("stage"), F.col("seq")], "place")


def counts(items: DataFrame, key: str) -> DataFrame:
    """How many items each search gave, by tier; those without a tier were rejected."""
    return items.groupBy(key, "stage").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS], F.count_if(F.col("tier").isNull()).alias("rejected")
    )


def status(top_tier: Column, n_items: Column, running: Column, failed: Column, finished: Column) -> Column:
    """One word for a claim: what was found goes before what still runs, that before partial support, leads, errors and nothing."""
    return (
        F.when(top_tier == "supports", "found")
        .when(running, "running")
        .when(top_tier == "partial", "partial")
        .when(n_items > 0, "leads")
        .when(failed, "error")
        .when(finished, "nothing")
        .otherwise("idle")
    )
