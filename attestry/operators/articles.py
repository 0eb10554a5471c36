"""Articles to rows: tagged claims, references, sections, sentences.  Each article is read once, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import markup, rendered, words

CLAIM = "claim_seq int, claim string, context string, section string, offset int, tag string, own_start int, own_end int, para_start int, para_end int, paragraph string"
REF = (
    "ref_seq int, name string, ref_group string, offset int, ref_end int, url string, title string, work string, author string, date string, quote string,"
    " template string, short_footnote boolean, raw string, source_text string, sentence string, paragraph string, section string, paste_here string, paste_elsewhere string"
)
SECTION = "heading string, level int, start int, section_end int"

#: Rows that a worker hands on at once.
ROWS = 2000


def _rows(df: DataFrame, keys: list[str], text: str, schema: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """The rows that ``make`` gives for each text, after the key columns; a worker never holds all rows of a batch of texts."""
    names = [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ((*k, *row) for *k, t in b.itertuples(index=False) if t is not None for row in make(t))
            while out := list(islice(found, ROWS)):
                yield pd.DataFrame(out, columns=[*keys, *names]).astype(object)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, text).mapInPandas(run, f"{kinds}, {schema}")


def claims(articles: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """A row for every tagged statement, with the spans of its own sentence and paragraph, the latter's text and its links."""

    def make(t: str) -> Iterator[tuple]:
        for k, c in enumerate(markup.claims(t)):
            own, para = markup.tagged_sentence(t, c.offset, c.offset + len(c.tag)), markup.paragraph_at(t, c.offset)
            yield k, c.claim, c.context, c.section, c.offset, c.tag, *own, *para, t[para[0] : para[1]]

    return _rows(articles, keys, text, CLAIM, make).withColumn("links", C.wikilinks(F.col("paragraph")))


def claims_with_anchors(articles: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """``claims`` with numbers and names of the claim, and the numbers of its context, in the same pass over the article."""

    def make(t: str) -> Iterator[tuple]:
        for k, c in enumerate(markup.claims(t)):
            own, para = markup.tagged_sentence(t, c.offset, c.offset + len(c.tag)), markup.paragraph_at(t, c.offset)
            numbers, names = words.anchors(c.claim)
            yield k, c.claim, c.context, c.section, c.offset, c.tag, *own, *para, t[para[0] : para[1]], numbers, names, words.anchor_numbers(c.context)

    schema = f"{CLAIM}, numbers array<string>, names array<string>, context_numbers array<string>"
    return _rows(articles, keys, text, schema, make).withColumn("links", C.wikilinks(F.col("paragraph")))


def indexed_refs(articles: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    """A row for every reference that stands in the prose, with what it cites and what it stands behind."""

    def make(t: str) -> Iterator[tuple]:
        for k, x in enumerate(markup.index_article(t)):
            s = x.source
            yield (
                k, x.ref.name, x.ref.group, x.ref.offset, x.ref.end, s.url, s.label, s.work, s.author, s.date, s.quote, s.template, s.short_footnote, s.raw, s.text,
                x.sentence, x.paragraph, x.section, markup.reuse(x, True), markup.reuse(x, False),
            )

    return _rows(articles, keys, text, REF, make)


def sections(articles: DataFrame, keys: list[str], text: str = "wikitext") -> DataFrame:
    return _rows(articles, keys, text, SECTION, lambda t: [(s.heading, s.level, s.start, s.end) for s in markup.sections(t)])


def sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return _rows(texts, keys, text, "seq int, sentence string, start int", lambda t: [(k, t[a:b], a) for k, (a, b) in enumerate(markup.sentence_spans(t))])


def anchors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return _rows(texts, keys, text, "numbers array<string>, names array<string>", lambda t: [words.anchors(t)])


def key_phrases(texts: DataFrame, keys: list[str], text: str, subject: str = "") -> DataFrame:
    return _rows(texts, keys, text, "phrases array<string>", lambda t: [(words.key_phrases(t, subject),)])


def page_blocks(pages: DataFrame, keys: list[str], html: str = "html", prefix: str = "/wiki/") -> DataFrame:
    """A row for every block of a rendered page: its tag, the heading it stands under (or null), what a reader sees, and the articles it links to."""
    schema = "seq int, block_tag string, section string, text string, links array<string>"
    return _rows(pages, keys, html, schema, lambda t: [(k, *row) for k, row in enumerate(rendered.blocks(t, prefix))])


def page_claims(pages: DataFrame, keys: list[str], html: str = "html", prefix: str = "/wiki/") -> DataFrame:
    """A row for every statement tagged in a rendered page, with its block's text, heading and links."""
    schema = "claim_seq int, claim string, context string, section string, links array<string>"
    return _rows(pages, keys, html, schema, lambda t: [(k, *row) for k, row in enumerate(rendered.tagged(t, prefix))])


def paragraphs(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """start and end of every paragraph between blank lines: lengths only are exchanged, and summed up along each text."""
    numbered = texts.select(*keys, F.monotonically_increasing_id().alias("__row"), F.transform(F.split(text, "\n\n"), F.length).alias("__sizes"))
    rows = numbered.select(*keys, "__row", F.posexplode("__sizes").alias("__at", "__size"))
    upto = F.sum(F.col("__size") + 2).over(Window.partitionBy("__row").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    start = (upto - 2 - F.col("__size")).cast("int").alias("start")
    return rows.select(*keys, start, "__size").where("__size > 0").select(*keys, "start", (F.col("start") + F.col("__size")).alias("end"))
