"""What is asked of services: addresses, bodies and prompts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

#: How much of a paragraph, a title and a sentence a prompt holds.
PARAGRAPH, CONTEXT, TITLE, SENTENCE, QUERY, PAGE = 2000, 1200, 160, 600, 400, 6000


def _escaped(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def stream_url(identifier: Column, file: Column) -> Column:
    return F.concat(F.lit("https://archive.org/stream/"), _escaped(identifier), F.lit("/"), _escaped(file), F.lit("_djvu.txt"))


def search_params(query: Column, size: Column) -> Column:
    return F.concat(F.lit("service_backend=fts&user_query="), F.url_encode(query), F.lit("&hits_per_page="), size.cast("string"))


def catalogue_url(query: Column, rows: Column) -> Column:
    fields = "".join(f"&fl[]={f}" for f in ("identifier", "title", "creator", "year", "date", "collection", "mediatype"))
    asked = _escaped(F.concat(F.lit("("), query, F.lit(") AND mediatype:texts")))
    return F.concat(F.lit("https://archive.org/advancedsearch.php?q="), asked, F.lit(f"{fields}&rows="), rows.cast("string"), F.lit("&output=json"))


def lookup_url(lang: Column, query: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/api/rest_v1/data/citation/mediawiki/"), _escaped(query))


def chat_body(model: Column, system: Column, user: Column, most: int, effort: Column | None = None) -> Column:
    """A chat request at temperature 0."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [model.alias("model"), F.lit(most).alias("max_tokens"), F.lit(0).alias("temperature"), F.array(message("system", system), message("user", user)).alias("messages")]
    return F.to_json(F.struct(*parts, *([effort.alias("reasoning_effort")] if effort is not None else [])))


def _named(title: Column) -> Column:
    return F.replace(title, F.lit("_"), F.lit(" "))


def plan_prompt(title: Column, section: Column, paragraph: Column, claim: Column) -> Column:
    where = F.coalesce(F.nullif(section, F.lit("")), F.lit("(lead)"))
    return F.concat(F.lit("Article: "), _named(title), F.lit("\nSection: "), where, F.lit("\nParagraph: "), C.clip(paragraph, PARAGRAPH), F.lit("\n\nClaim: "), claim)


def books_prompt(title: Column, paragraph: Column, claim: Column) -> Column:
    return F.concat(F.lit("Article: "), _named(title), F.lit("\nParagraph: "), C.clip(paragraph, PARAGRAPH), F.lit("\n\nClaim: "), claim)


def _head(title: Column, claim: Column, paragraph: Column, fact: Column | None = None) -> Column:
    told = F.lit("") if fact is None else F.coalesce(F.when(fact != claim, F.concat(F.lit("What the claim says, with the names its paragraph gives: "), fact, F.lit("\n"))), F.lit(""))
    return F.concat(F.lit("Article: "), _named(title), F.lit("\nClaim: "), claim, F.lit("\n"), told, F.lit("The claim's paragraph, for context only: "), C.clip(paragraph, CONTEXT), F.lit("\n"))


def judge_prompt(title: Column, claim: Column, paragraph: Column, fact: Column, books: Column, budget: int = 1600) -> Column:
    """``books``: array of (title, year, passages); a book's passages go as far as the budget holds them, the first in any case."""

    def shown(passages: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            fits = ~s["over"] & ((s["used"] + F.length(p) <= budget) | (F.size(s["lines"]) == 0))
            return F.struct(
                F.when(fits, s["used"] + F.length(p)).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["lines"], F.array(F.concat(F.lit("- "), p)))).otherwise(s["lines"]).alias("lines"), (~fits).alias("over")
            )

        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("over"))
        lines = F.aggregate(F.transform(passages, lambda p: C.clip(p, SENTENCE)), start, add, lambda s: F.array_join(s["lines"], "\n"))
        return F.when(lines == "", "- (no passage)").otherwise(lines)

    def entry(b: Column, i: Column) -> Column:
        year = F.coalesce(F.concat(F.lit(" ("), b["year"].cast("string"), F.lit(")")), F.lit(""))
        return F.concat(F.lit("B"), (i + 1).cast("string"), F.lit(". "), C.clip(b["title"], TITLE), year, F.lit("\n"), shown(b["passages"]))

    return F.concat(_head(title, claim, paragraph, fact), F.lit("\n"), F.array_join(F.transform(books, entry), "\n\n"))


def same_fact_prompt(title: Column, claim: Column, paragraph: Column, leads: Column) -> Column:
    """``leads``: array of (lang, article, section, sentence)."""

    def entry(x: Column, i: Column) -> Column:
        section = F.coalesce(F.concat(F.lit(', section "'), C.clip(x["section"], 80), F.lit('"')), F.lit(""))
        return F.concat(F.lit("S"), (i + 1).cast("string"), F.lit(". "), x["lang"], F.lit(".wikipedia, "), C.clip(x["article"], 120), section, F.lit(":\n"), C.clip(x["sentence"], SENTENCE))

    return F.concat(_head(title, claim, paragraph), F.lit("\n"), F.array_join(F.transform(leads, entry), "\n\n"))


def source_prompt(title: Column, claim: Column, paragraph: Column, source: Column, url: Column, text: Column, quoted: Column) -> Column:
    where = F.coalesce(F.concat(F.lit(" ("), url, F.lit(")")), F.lit(""))
    kind = F.when(quoted, "Only the passage its citation quotes is available:\n").otherwise("Text:\n")
    return F.concat(_head(title, claim, paragraph), F.lit("\nSource: "), C.clip(source, 200), where, F.lit("\n"), kind, text)


def web_message(title: Column, section: Column, context: Column, claim: Column) -> Column:
    where = F.coalesce(F.nullif(section, F.lit("")), F.lit("(none)"))
    return F.concat(F.lit("Claim: "), claim, F.lit("\n\nContext: "), context, F.lit("\n\nSection: "), where, F.lit("\n\nArticle: "), _named(title))


def web_query(title: Column, claim: Column) -> Column:
    return F.left(F.concat(_named(title), F.lit(": "), F.trim(F.regexp_replace(claim, r"\s+", " "))), F.lit(QUERY))


def numbered_results(results: Column) -> Column:
    """``results``: array of (url, title, content, raw_content), as a model reads them."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))

    def entry(r: Column, i: Column) -> Column:
        page = tidy(r["raw_content"])
        cut = F.when(F.length(page) > PAGE, F.concat(F.left(page, F.lit(PAGE)), F.lit(" […]"))).otherwise(page)
        rest = F.when(page != "", F.concat(F.lit("\nPage text: "), cut)).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["url"], F.lit("\nTitle: "), F.coalesce(r["title"], F.lit("")), F.lit("\nExcerpts: "), tidy(r["content"]), rest)

    return F.array_join(F.transform(results, entry), "\n\n")
