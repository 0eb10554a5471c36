"""Edits of articles as tables: a row for every tag, every edit asked for, every claim to be found in its article."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits, markup
from .articles import _rows
from .library import _each


def tags(articles: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """nth, start, tag_end, name, wraps and wrapped (the claim inside) of every tag that a reader sees, with its sentence's span."""

    def make(t: str) -> Iterable[tuple]:
        for k, (a, b, name) in enumerate(edits.tags(t)):
            wraps = name in edits.WRAPPING
            yield k, a, b, name, wraps, edits.wrapped_text(t[a + 2 : b - 2]) if wraps else None, *edits.tagged_span(t, k)

    return _rows(articles, keys, text, "nth int, start int, tag_end int, name string, wraps boolean, wrapped string, span_start int, span_end int", make)


def replaced(asked: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """keys and edited: ``asked`` (text, nth, reference) with its tag replaced; null where there is no such tag."""
    return _each(asked.select(*keys, text, "nth", "reference"), keys, "edited string", lambda r: (edits.replace_tag(getattr(r, text) or "", r.nth, r.reference),))


def removed(asked: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """keys, edited and lost: ``asked`` (text, nth) without its tag's sentence, and the references that lose their definition."""
    make = lambda r: edits.remove_tagged(getattr(r, text) or "", r.nth) or (None, [])
    return _each(asked.select(*keys, text, "nth"), keys, "edited string, lost array<string>", make)


def citation_points(asked: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """keys and point: where a reference for the text up to ``after`` goes."""
    return _each(asked.select(*keys, text, "after"), keys, "point int", lambda r: (edits.citation_point(getattr(r, text) or "", r.after),))


def located(asked: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """keys, start and claim_end of ``asked`` (text, claim, before): start is null where only the claim's last words are found, both where none are."""
    make = lambda r: edits.locate(getattr(r, text) or "", r.claim or "", r.before or "") or (None, None)
    return _each(asked.select(*keys, text, "claim", "before"), keys, "start int, claim_end int", make)


def restated(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and restates: whether the last sentence of ``prose`` says what ``claim`` says."""
    make = lambda r: (edits.restates(edits.last_sentence(r.prose or ""), r.claim or ""),)
    return _each(pairs.select(*keys, "prose", "claim"), keys, "restates boolean", make)


def claims_at(articles: DataFrame, keys: list[str], offsets: DataFrame, text: str = "wikitext") -> DataFrame:
    """keys, offset and claim: the claim at each recorded ``offsets`` (keys, offset), null where no tag is there any more."""

    def make(t: str) -> Iterable[tuple]:
        return [(c.offset, c.claim) for c in markup.claims(t)]

    return offsets.join(_rows(articles, keys, text, "offset int, claim string", make), [*keys, "offset"], "left")


def claim_positions(asked: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """keys, start and end of where each of ``asked`` (text, nth, picked, claim, before) stands: its tag, or for a picked claim the point at which its
    reference would go; null where there is no such tag or the claim is not found."""

    def make(r) -> tuple:
        own = getattr(r, text) or ""
        if r.picked:
            found = edits.locate(own, r.claim or "", r.before or "")
            point = edits.citation_point(own, found[1]) if found else None
            return point, point
        tag = next(islice(edits.tags(own), int(r.nth), None), None) if pd.notna(r.nth) else None
        return (tag[0], tag[1]) if tag else (None, None)

    return _each(asked.select(*keys, text, "nth", F.coalesce("picked", F.lit(False)).alias("picked"), "claim", "before"), keys, "start int, end int", make)
