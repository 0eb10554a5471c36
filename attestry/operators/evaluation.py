"""Evaluation: sampling, claim F1, scores by method and group, confusion, changes between runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import numbered, small, top_k

GOOD = ("supports", "partial")


def usable(claim: Column) -> Column:
    """Null, or why a claim is no sentence to draw."""
    return (
        F.when(F.length(claim) < 30, "too short")
        .when(F.length(claim) > 700, "too long")
        .when(claim.rlike(r"^[|!{]") | F.contains(claim, F.lit("||")), "table or template")
        .when(F.size(F.split(claim, r"\s+")) < 5, "too few words")
    )


def seeded_index(df: DataFrame, seed: str, n: str, out: str = "pick") -> DataFrame:
    """``out``: a 32-bit multiplicative hash of the seed's UTF-16 units (offset 2166136261, factor 16777619), modulo ``n``."""

    @F.pandas_udf("long")
    def hashed(seeds: pd.Series) -> pd.Series:
        def one(s: str) -> int:
            h = 2166136261
            for c in s:
                h = (h ^ int.from_bytes(c.encode("utf-16-le", "surrogatepass")[:2], "little")) * 16777619 & 0xFFFFFFFF
            return h

        return seeds.map(one)

    return df.withColumn(out, hashed(F.col(seed)) % F.col(n))


def stratified(claims: DataFrame, quota: DataFrame, stratum: str, article: str, order: str) -> DataFrame:
    """One usable claim an article, drawn by its seeded index, until each stratum's quota (stratum, quota) is full."""
    ok = claims.where(usable(F.col("claim")).isNull())
    n = ok.groupBy(article).agg(F.count("*").alias("n"))
    picked = seeded_index(n, article, "n")
    one = numbered(ok, [article], [F.col(order)], "nth").join(picked, article).where(F.col("nth") == F.col("pick") + 1)
    most = quota.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    placed = top_k(one, [stratum], [F.col(article)], most, "place").join(small(quota), stratum)
    return placed.where(F.col("place") <= F.col("quota")).drop("n", "pick", "nth")


def f1_words(text: Column) -> Column:
    shown = F.regexp_replace(F.lower(text), r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    return F.regexp_extract_all(shown, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def by_method(claims: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """method, book_leaning (null: all), and shares: found, found or partly, any lead, good lead on top; leads, judged and precision.

    claims: claim_id, book_leaning; leads: claim_id, method, lead_key, score; labels: claim_id, lead_key, verdict.
    """
    judged = leads.join(labels, ["claim_id", "lead_key"], "left").withColumn("good", F.coalesce(F.col("verdict").isin(*GOOD), F.lit(False)))
    each = judged.unionByName(judged.withColumn("method", F.lit("any")))
    per_claim = each.groupBy("method", "claim_id").agg(
        F.bool_or(F.coalesce(F.col("verdict") == "supports", F.lit(False))).alias("found"), F.bool_or("good").alias("partly"), F.count("*").alias("leads"),
        F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != "unknown")).alias("judged"), F.count_if("good").alias("n_good"),
        F.max_by("good", F.struct("score", "lead_key")).alias("top_good"),
    )
    sizes = claims.groupingSets([["book_leaning"], []], "book_leaning").agg(F.count("*").alias("claims"))
    sums = per_claim.join(claims, "claim_id").groupingSets([["method", "book_leaning"], ["method"]], "method", "book_leaning").agg(
        F.count_if("found").alias("n_found"), F.count_if("partly").alias("n_partly"), F.count("*").alias("n_any"), F.count_if("top_good").alias("n_top"),
        F.sum("leads").alias("leads"), F.sum("judged").alias("judged"), F.sum("n_good").alias("n_good"),
    )
    out = sums.join(sizes, sums["book_leaning"].eqNullSafe(sizes["book_leaning"])).drop(sizes["book_leaning"])
    pct = lambda a, b: F.when(b > 0, F.floor(100 * a / b + 0.5).cast("long"))
    return out.select(
        "method", "book_leaning", "claims", pct(F.col("n_found"), F.col("claims")).alias("found"), pct(F.col("n_partly"), F.col("claims")).alias("partly"),
        pct(F.col("n_any"), F.col("claims")).alias("any_lead"), pct(F.col("n_top"), F.col("n_any")).alias("top_good"), "leads", "judged", pct(F.col("n_good"), F.col("judged")).alias("precision"),
    )


def confusion(pairs: DataFrame, said: str, label: str, values: list[str]) -> DataFrame:
    """How often each verdict met each label."""
    return pairs.groupBy(said).pivot(label, values).agg(F.count(F.lit(1))).na.fill(0)


def changes(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows gained and lost between two runs."""
    return now.join(before, keys, "left_anti").select(*keys, F.lit("gained").alias("change")).unionByName(before.join(now, keys, "left_anti").select(*keys, F.lit("lost").alias("change")))


def medians(df: DataFrame, by: list[str], value: str, parts: int = 256) -> DataFrame:
    """by, median: exact, without a group's values in one task; nulls do not count, and a group of nulls has no row.

    Values are counted, and the counts dealt to ranges whose bounds are approximate quantiles; the middle ranks fall into one or two ranges, and only
    these are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10 * parts)).alias("bounds"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    dealt = counts.alias("c").join(bounds.alias("b"), reduce(and_, same)).select("c.*", F.size(F.filter("bounds", lambda x: x < F.col("v"))).alias("part"))
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    upto = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("in_part").over(upto) - F.col("in_part")).withColumn("total", F.sum("in_part").over(Window.partitionBy(*by)))
    # Ranks from 0; an even number of values has two in the middle.
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda first, n: ((low >= first) & (low < first + n)) | ((high >= first) & (high < first + n))
    middle = sums.where(holds(F.col("before"), F.col("in_part")))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*by, "part"]]
    rows = dealt.alias("d").join(middle.alias("m"), reduce(and_, same)).select("d.*", "before", "total")
    first = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    kept = rows.withColumn("first", first).where(holds(F.col("first"), F.col("n")))
    return kept.groupBy(*by).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def usage(calls: DataFrame, by: list[str], ms: str, tokens: str) -> DataFrame:
    """Calls, tokens, median and slowest time of recorded model calls."""
    told = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.max(ms).alias("slowest_ms"))
    half = medians(calls, by, ms)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
    return told.alias("t").join(half.alias("h"), reduce(and_, same), "left").select("t.*", F.col("median").alias("median_ms"))


def request_key(url: Column, method: Column, body: Column, ignored: tuple[str, ...] = ("origin", "format", "formatversion")) -> Column:
    """A request's identity: method, host, path, sorted query without noise, and a digest of the body."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*ignored)))
    rest = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    digest = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("#"), F.left(F.sha1(body.cast("binary")), F.lit(16)))).otherwise("")
    return F.concat(F.upper(method), F.lit(" "), F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), rest, digest)


def cassette_path(key: Column) -> Column:
    """Where the recording of a request key lies: its host's folder, a digest as its name."""
    where = F.substring_index(F.element_at(F.split(key, " "), 2), "/", 1)
    return F.concat(where, F.lit("/"), F.left(F.sha1(key.cast("binary")), F.lit(20)), F.lit(".json.gz"))


def replayed(requests: DataFrame, recorded: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their recorded replies; one without a recording is an error row, not a failure."""
    return requests.join(recorded, key, "left").withColumn("error", F.when(F.col("status").isNull(), "no recording").when((F.col("status") == 429) | (F.col("status") >= 500), "transient"))

