"""Checks of leads: what a service's verdict says of a sister sentence or a book, a lead's source read and judged, and where searches stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .replies import json_object
from .verdicts import sister_outcome

#: How many characters of a source a judge reads, how few are no source, and how long a quotation must be to stand for one.
SOURCE_MOST, SOURCE_LEAST, QUOTE_LEAST = 50_000, 100, 20


def _spoken(verdict: Column, supported: str, partly: str, unsupported: str) -> Column:
    v = F.upper(F.trim(verdict))
    return F.when(v == "SUPPORTED", supported).when(v == "PARTIALLY SUPPORTED", partly).when(v == "NOT SUPPORTED", unsupported)


def fact_of(verdict: Column) -> Column:
    """A service's verdict on a sister sentence: same, partial or no; null for any other answer."""
    return _spoken(verdict, "same", "partial", "no")


def book_verdict_of(verdict: Column) -> Column:
    """A service's verdict on a book's passages: supports, partial or unsupported; null, unchecked, for any other answer."""
    return _spoken(verdict, "supports", "partial", "unsupported")


def passes_same_fact(fact: Column) -> Column:
    return F.coalesce(fact.isin("same", "partial"), F.lit(False))


def worth_keeping(verdict: Column) -> Column:
    """The book states the claim, or a part of it."""
    return F.coalesce(verdict.isin("supports", "partial"), F.lit(False))


def passages_text(passages: Column) -> Column:
    """What a service reads as a book: its passages, one a line, without title and year, which are no evidence."""
    return F.array_join(passages, "\n")


def source_text(content: Column, cut: Column, quote: Column, error: Column, status: Column) -> Column:
    """struct(text, origin, truncated, error): a page's text if there is enough of it, else the citation's own quotation, else why neither."""
    page, words = F.coalesce(F.trim(content), F.lit("")), F.trim(quote)
    none = F.lit(None).cast("string")
    why = F.coalesce(error, F.when(page != "", "the page has almost no text"), F.concat(F.lit("HTTP "), status.cast("string")), F.lit("no URL"))
    read = F.struct(
        F.left(page, F.lit(SOURCE_MOST)).alias("text"), F.lit("page").alias("origin"), (F.coalesce(cut, F.lit(False)) | (F.length(page) > SOURCE_MOST)).alias("truncated"), none.alias("error")
    )
    quoted = F.struct(words.alias("text"), F.lit("quote").alias("origin"), F.lit(True).alias("truncated"), none.alias("error"))
    unread = F.struct(none.alias("text"), none.alias("origin"), F.lit(None).cast("boolean").alias("truncated"), why.alias("error"))
    return F.when(F.length(page) >= SOURCE_LEAST, read).when(F.length(words) >= QUOTE_LEAST, quoted).otherwise(unread)


def source_verdict(reply: Column, text: Column) -> Column:
    """struct(verdict, quote, reason) of a judge's reply on one source; verdict is null where the reply has none that is known.

    Support counts only with words that are in the source.
    """
    said = F.from_json(json_object(reply), "verdict string, quote string, why string")
    v, quote, why = F.lower(F.trim(said["verdict"])), F.trim(F.coalesce(said["quote"], F.lit(""))), F.trim(F.coalesce(said["why"], F.lit("")))
    stated, there = v.isin("supports", "partial"), C.quote_in_passages(quote, F.array(text))
    verdict = F.when(stated & there, v).when(stated | v.isin("no", "unsupported"), "unsupported")
    reason = F.when(stated & ~there, F.trim(F.concat(F.lit("Not counted: its quote is not in the source. "), why))).otherwise(why)
    return F.struct(verdict.alias("verdict"), F.when(stated & there, quote).otherwise("").alias("quote"), reason.alias("reason"))


def checked_sources(leads: DataFrame, pages: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """``leads`` (keys, url, quote, fact) with source, read (verdict, quote, reason) and outcome; only those cited for the same fact are read.

    pages: url, content, truncated, error, status; replies: keys, reply (a judge's), verdict and comments (a service's, where the judge failed).
    """
    fetched = pages.select("url", F.struct("content", "truncated", "error", "status").alias("page"))
    wanted = leads.join(fetched, "url", "left").join(replies.select(*keys, "reply", "verdict", "comments"), keys, "left")
    passing = passes_same_fact(F.col("fact"))
    source = source_text(F.col("page.content"), F.col("page.truncated"), F.col("quote"), F.col("page.error"), F.col("page.status"))
    wanted = wanted.withColumn("source", F.when(passing, source))
    judged = source_verdict(F.col("reply"), F.col("source.text"))
    served = F.struct(book_verdict_of(F.col("verdict")).alias("verdict"), F.lit("").alias("quote"), F.coalesce("comments", F.lit("")).alias("reason"))
    read = F.when(F.col("source.text").isNotNull(), F.when(json_object(F.col("reply")).isNotNull(), judged).otherwise(served))
    out = wanted.withColumn("read", read)
    outcome = sister_outcome(F.lit(True), F.col("fact"), F.col("read.verdict"), F.col("source.truncated"))
    return out.withColumn("outcome", outcome).select(*leads.columns, "source", "read", "outcome")


def stages(wiki: Column, wiki_check: Column, books: Column, n_books: Column, books_check: Column, web: Column, searchable: Column) -> Column:
    """struct(wiki, books, web): where each search of a claim stands; a search whose leads are being checked is still running."""
    idle = lambda c: F.coalesce(c, F.lit("idle"))
    checking = (F.coalesce(n_books, F.lit(0)) > 0) & (books_check.isNull() | (books_check == "running"))
    of_books = F.when(~searchable, "none").when(idle(books) != "done", idle(books)).when(checking, "running").otherwise("done")
    of_wiki = F.when((wiki == "done") & F.coalesce(wiki_check == "running", F.lit(False)), "running").otherwise(idle(wiki))
    return F.struct(of_wiki.alias("wiki"), of_books.alias("books"), idle(web).alias("web"))


def archive_check_wanted(verdict: Column) -> Column:
    """Whether a book's verdict says that it states the claim, or part of it: only then are its whole pages looked at."""
    return F.coalesce(verdict.isin("supports", "partial"), F.lit(False))
