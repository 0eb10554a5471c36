"""Leads for tagged claims from citations that articles already hold: the article's own and its sister editions'."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed, words
from .joins import first_per_key, top_k

LEAD = ["origin", "seq", "url", "title", "sentence", "section", "score", "matched", "raw", "paste"]


def same_article(claims: DataFrame, refs: DataFrame, articles: DataFrame, key: str = "article_id", least: float = 0.3) -> DataFrame:
    """Leads from references of the claim's paragraph or section, but not of its own sentence, by shared words and nearness."""
    titles = articles.select(key, F.col("title").alias("article_title"))
    c = claims.select(key, "claim_seq", "claim", F.col("section").alias("claim_section"), F.col("offset").alias("claim_offset"), "own_start", "own_end", "para_start", "para_end").join(titles, key)
    background = C.tokens(F.concat_ws(" ", "article_title", F.coalesce("claim_section", F.lit(""))))
    c = c.withColumn("bag", C.weighted_tokens(F.col("claim"), background))
    heaviest = lambda bag, k: F.array_max(F.transform(F.filter(bag, lambda t: t["token"] == k), lambda t: t["weight"]))
    each = F.transform(F.array_distinct(F.transform("bag", lambda t: t["token"])), lambda k: F.struct(k.alias("token"), heaviest(F.col("bag"), k).alias("weight")))
    c = c.withColumn("bag", each).withColumn("total", F.aggregate("bag", F.lit(0.0), lambda a, t: a + t["weight"]))
    r = refs.where(F.col("ref_group").isNull() & ~F.coalesce(C.is_unreliable(F.col("url")), F.lit(False)))
    r = r.withColumn("words", F.concat_ws(" ", "source_text", "sentence"))
    pair = c.join(r, key)
    paragraph = (F.col("offset") >= F.col("para_start")) & (F.col("offset") < F.col("para_end"))
    own = (F.col("offset") >= F.col("own_start")) & (F.col("offset") < F.col("own_end"))
    near = F.coalesce(F.col("section") == F.col("claim_section"), F.lit(False))
    pair = pair.withColumn("in_paragraph", paragraph).where(~own & (paragraph | near))
    weight = lambda held: F.aggregate("bag", F.lit(0.0), lambda a, t: a + F.when(held(t["token"]), t["weight"]).otherwise(0.0))
    # In plain texts a token stands as it is; where not enough stand anywhere in the letters, words need not be told apart.
    plain = C.is_ascii(F.col("words")) & ~F.col("words").rlike("[0-9][,.][0-9]{3}")
    most = C.bound(F.lower("words"), lambda low: weight(lambda token: F.contains(low, token)))
    pair = pair.where(~plain | ((F.col("total") > 0) & (most >= 0.2 * F.col("total") - 1e-9)))
    hit = C.bound(C.tokens(F.col("words")), lambda have: weight(lambda token: F.array_contains(have, token)))
    pair = pair.withColumn("lexical", F.when(F.col("total") > 0, hit / F.col("total")).otherwise(0.0))
    nearness = F.when(F.col("in_paragraph"), F.when(F.abs(F.col("offset") - F.col("claim_offset")) < 200, 1.0).otherwise(0.5)).otherwise(0.25)
    floor = F.when(F.col("in_paragraph"), 0.2).otherwise(0.35)
    pair = pair.withColumn("score", 0.75 * F.col("lexical") + 0.25 * nearness)
    kept = pair.where((F.col("lexical") >= floor) & (F.col("score") >= least) & (F.col("url").isNotNull() | (F.col("lexical") >= 0.4)))
    return kept.select(
        key, "claim_seq", F.lit("same-article").alias("origin"), F.col("ref_seq").alias("seq"), "url", "title", "sentence", "section", F.round("score", 3).alias("score"),
        F.array().cast("array<string>").alias("matched"), "raw", F.col("paste_here").alias("paste"),
    )


def _scored(claims: DataFrame, refs: DataFrame, keys: list[str], carried: list[str], least: float) -> DataFrame:
    """claims' ``keys``, the ``carried`` columns of refs (sentence among them), score, matched: the pairs of a claim and a reference of one sister that score enough.

    Both come by sister_id.  A reference meets all claims of its article at once, so that its sentence and paragraph are looked through once; the better
    of both scores counts, by the sentence's preference, and only pairs that score enough go on.
    """
    asked = claims.groupBy("sister_id").agg(F.collect_list(F.struct(*keys, "numbers", "names", "translated", "same_script")).alias("claims"))
    rows = refs.select("sister_id", *carried, "paragraph").join(asked, "sister_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, found = [], []
            for k, (sentence, paragraph, own) in enumerate(zip(b["sentence"], b["paragraph"], b["claims"], strict=True)):
                for c in own:
                    extra, names = list(c["translated"]), list(c["names"]) if c["same_script"] else []
                    on, around = (words.anchor_score(list(c["numbers"]), names, t, extra) for t in (sentence or "", paragraph or ""))
                    score, matched = on if on[0] >= around[0] * 0.9 else (around[0] * 0.7, around[1])
                    if (score >= 0.8 and matched) or (score >= least and len(matched) >= 2):
                        at.append(k)
                        found.append((*(c[x] for x in keys), score, matched))
            yield pd.concat([b[carried].iloc[at].reset_index(drop=True), pd.DataFrame(found, columns=[*keys, "score", "matched"])], axis=1)[[*keys, *carried, "score", "matched"]]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, names in ((claims, keys), (refs, carried)) for c in names)
    return rows.mapInPandas(run, f"{kinds}, score double, matched array<string>")


def sister_editions(claims: DataFrame, refs: DataFrame, sisters: DataFrame, translations: DataFrame, key: str = "article_id", least: float = 0.5) -> DataFrame:
    """Leads from references of other editions, by the numbers and names that a sentence keeps in translation.

    claims: with numbers, names (of the claim) and context_numbers, latin (of its article); sisters: article_id, sister_id, lang, latin; refs: by
    sister_id; translations: title, lang, foreign (of link targets).
    """
    c = claims.withColumn("numbers", F.when(F.size("numbers") > 0, F.col("numbers")).otherwise(F.col("context_numbers")))
    c = c.where(F.size("numbers") + F.size("names") >= 2).select(key, "claim_seq", "numbers", "names", "links", F.col("latin").alias("own_latin"))
    s = sisters.select(key, "sister_id", "lang", F.col("latin").alias("sister_latin"))
    both = c.join(s, key)
    linked = both.select(key, "claim_seq", "sister_id", "lang", F.posexplode("links").alias("pos", "title")).join(translations, ["title", "lang"])
    told = linked.groupBy(key, "claim_seq", "sister_id").agg(F.array_sort(F.collect_list(F.struct("pos", "foreign"))).alias("t"))
    both = both.join(told, [key, "claim_seq", "sister_id"], "left").withColumn("translated", F.coalesce(F.transform("t", lambda x: x["foreign"]), F.array().cast("array<string>"))).drop("t")
    both = both.withColumn("same_script", F.col("own_latin") & F.col("sister_latin"))
    scope = F.size("numbers") + F.when(F.col("same_script"), F.size("names")).otherwise(0) + F.size("translated")
    r = refs.where(F.col("ref_group").isNull() & F.col("url").isNotNull() & ~C.is_unreliable(F.col("url")))
    keys, carried = [key, "claim_seq", "lang"], ["ref_seq", "url", "title", "sentence", "section", "raw", "paste_elsewhere"]
    kept = _scored(both.where(scope >= 2), r, keys, carried, least)
    preference = F.array_position(F.array(*map(F.lit, fixed.SISTER_LANGUAGES)), F.col("lang"))
    return kept.select(
        key, "claim_seq", F.lit("sister-wiki").alias("origin"), (preference * 1_000_000 + F.col("ref_seq")).cast("int").alias("seq"), "url", "title", "sentence", "section",
        F.round("score", 3).alias("score"), "matched", "raw", F.col("paste_elsewhere").alias("paste"),
    )


def ranked(own: DataFrame, sister: DataFrame, key: str = "article_id", most: int = 5) -> DataFrame:
    """Both passes' leads, the best of each address, the first ``most`` of each claim.  On a tie the article's own comes first as an
    address's lead, and the sister's in the order of leads."""
    union = own.unionByName(sister).withColumn("lead_key", F.coalesce(C.url_key(F.col("url")), F.concat(F.lit("raw:"), F.col("raw"))))
    first_pass = F.when(F.col("origin") == "same-article", 0).otherwise(1)
    best = first_per_key(union, [key, "claim_seq", "lead_key"], F.struct((-F.col("score")).alias("s"), first_pass.alias("p"), "seq"))
    order = [F.desc("score"), F.when(F.col("origin") == "sister-wiki", 0).otherwise(1), F.col("seq"), F.col("lead_key")]
    return top_k(best, [key, "claim_seq"], order, most)


def choose_sisters(links: DataFrame, key: str = "article_id", most: int = 4) -> DataFrame:
    """Of an article's other editions (article_id, own_lang, lang, title), the first ``most`` by preference."""
    place = F.array_position(F.array(*map(F.lit, fixed.SISTER_LANGUAGES)), F.col("lang"))
    return top_k(links.where((F.col("lang") != F.col("own_lang")) & (place > 0)).withColumn("place", place), [key], [F.col("place"), F.col("title")], most)
