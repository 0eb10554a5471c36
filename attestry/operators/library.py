"""Book search results: from search replies to ranked leads.

Hits are rows (claim_id, rank, identifier, title, creator, year, mediatype, collections, file, highlights, query).  What is greedy and
depends on order (one scan a work, one lead a text) runs by claim over the few leads that are left; all else is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import words
from .joins import numbered, settled, small, top_k

#: Fixed value: the life dates that end a creator's name.
LIFE_DATES = r",?\s*\(?[0-9]{4}\s*-\s*([0-9]{4})?\)?\.?\s*$"


def first_value(raw: Column) -> Column:
    """A field that may be a value or a list of values, as JSON text: the first value."""
    listed = F.from_json(raw, "array<string>")
    return F.when(F.ltrim(raw).startswith("["), F.get(listed, 0)).otherwise(raw)


def all_values(raw: Column) -> Column:
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.ltrim(raw).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(raw))


_FIELDS = "identifier string, title string, creator string, year string, date string, mediatype string, collection string, file_basename string"
_SEARCH = f"response struct<body: struct<hits: struct<first: int, hits: array<struct<fields: struct<{_FIELDS.replace(' string', ': string')}>, highlight: struct<text: string>>>>>>"
_CATALOGUE = f"response struct<docs: array<struct<{_FIELDS.replace(' string', ': string')}>>>"


def _hits(rows: DataFrame, keys: list[str], fields: str, highlights: Column, file: Column) -> DataFrame:
    f = lambda name: first_value(F.col(f"{fields}.{name}"))
    out = rows.select(
        *keys, F.col("rank"), f("identifier").alias("identifier"), F.coalesce(f("title"), f("identifier")).alias("title"), f("creator").alias("creator"),
        F.coalesce(C.year_of(f("year")), C.year_of(f("date"))).alias("year"), f("mediatype").alias("mediatype"),
        all_values(F.col(f"{fields}.collection")).alias("collections"), file.alias("file"), highlights.alias("highlights"),
    )
    return out.where(F.coalesce(F.col("identifier"), F.lit("")) != "")


def search_hits(replies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """The books of full-text search replies (JSON text), in reply order, with their passages.

    A long reply may come in parts, rows of one request whose ``first`` says how many hits the parts before have.
    """
    parts = replies.select(*keys, F.from_json(body, _SEARCH)["response"]["body"]["hits"].alias("part"))
    rows = parts.select(*keys, F.coalesce("part.first", F.lit(0)).alias("first"), F.posexplode("part.hits").alias("pos", "hit"))
    rows = rows.select(*keys, (F.col("first") + F.col("pos")).alias("rank"), "hit")
    shown = F.filter(F.transform(all_values(F.col("hit.highlight.text")), C.strip_highlight), lambda t: t != "")
    return _hits(rows, keys, "hit.fields", shown, first_value(F.col("hit.fields.file_basename")))


def catalogue_hits(replies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """The books of catalogue replies: no passages."""
    rows = replies.select(*keys, F.posexplode(F.from_json(body, _CATALOGUE)["response"]["docs"]).alias("rank", "doc"))
    return _hits(rows, keys, "doc", F.array().cast("array<string>"), F.lit(None).cast("string"))


def item_details(replies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """publisher, isbn, dark, restricted and the names of the item's texts."""
    parsed = F.from_json(body, "metadata map<string,string>, is_dark string, files array<struct<name: string>>")
    text = F.filter(F.transform(F.coalesce(F.col("d.files"), F.array().cast("array<struct<name:string>>")), lambda f: f["name"]), lambda n: n.endswith("_djvu.txt"))
    return replies.select(*keys, parsed.alias("d")).select(
        *keys, first_value(F.col("d.metadata")["publisher"]).alias("publisher"), first_value(F.col("d.metadata")["isbn"]).alias("isbn"),
        (F.coalesce(F.col("d.is_dark"), F.lit("")) == "true").alias("dark"),
        (F.lower(F.coalesce(first_value(F.col("d.metadata")["access-restricted-item"]), F.lit(""))) == "true").alias("restricted"),
        F.transform(text, lambda n: F.left(n, F.length(n) - 9)).alias("books"),
    )


def bundled_book(file: Column, books: Column) -> Column:
    return F.when((F.size(books) > 1) & F.array_contains(books, file), file)


def gated(hits: DataFrame) -> DataFrame:
    """Hits with gate: struct(ok, access, reason)."""
    return hits.withColumn("gate", C.access_gate(F.col("mediatype"), F.col("collections")))


def title_is_about(title: Column, subject: Column) -> Column:
    tokens = C.tokens(subject)
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, C.tokens(title))) == 0)


def mentions_subject(text: Column, subject: Column) -> Column:
    tokens = C.tokens(subject)
    return (F.size(tokens) == 0) | F.arrays_overlap(tokens, C.tokens(text))


#: Rows that are Python objects in a worker at once.
ROWS = 128
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _each(df: DataFrame, keep: list[str], schema: str, make: Callable) -> DataFrame:
    """The columns ``keep`` of every row, and what ``make`` gives for it; of a batch of whole texts only a few rows become Python objects at a time."""
    names, types = zip(*(p.strip().split(" ") for p in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                got = zip(*map(make, part.to_pandas().itertuples(index=False)), strict=True)
                made = [pa.array(values, _ARROW[t]) for values, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.mapInArrow(run, f"{kinds}, {schema}")


def judged_passages(hits: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for every passage of every readable hit: its score and anchors, or the first gate that it failed.

    ``claims``: claim_id, claim, article_title.  A periodical's own year is no evidence.
    """
    readable = gated(hits).where("gate.ok").join(claims.select("claim_id", "claim", C.subject_of(F.col("article_title")).alias("subject")), "claim_id")
    rows = readable.withColumn("about", title_is_about(F.col("title"), F.col("subject"))).withColumn(
        "dateline", F.when(F.array_contains("collections", "periodicals"), F.col("year").cast("string"))
    )
    rows = rows.select("claim_id", "identifier", "rank", F.col("gate.access").alias("access"), "claim", "subject", "about", "dateline", F.posexplode("highlights").alias("pos", "text"))
    keep = ["claim_id", "identifier", "rank", "access", "pos", "text"]
    return _each(rows, keep, "score double, matched array<string>, reason string", lambda r: words.judge_passage(r.text, r.claim, r.subject, r.about, r.dateline))


def passage_stats(judged: DataFrame, least: float = 0.3) -> DataFrame:
    """claim_id, seen, and how many passages each gate dropped (reason to count)."""
    reason = F.coalesce("reason", F.when(F.col("score") < least, "below threshold"), F.lit("kept"))
    counts = judged.groupBy("claim_id", reason.alias("reason")).agg(F.count("*").alias("n"))
    return counts.groupBy("claim_id").agg(
        F.sum("n").alias("seen"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason") != "kept", F.struct("reason", "n"))))).alias("dropped")
    )


def one_per_work(leads: DataFrame, order: list[str]) -> DataFrame:
    """Leads (claim_id, title, creator) in order, without those that are a scan of a work already kept.

    Two leads are one work if their titles have one key and their creators share a word, or one has no creator: that is not transitive, so the
    order decides.  The choice is a fold over places and creators' words of a claim's leads of one title; other columns do not go through it.
    """
    creator = F.when(F.coalesce(F.col("creator"), F.lit("")) != "", C.tokens(F.regexp_replace("creator", LIFE_DATES, "")))
    keyed = leads.withColumn("edition", C.edition_key(F.col("title"))).withColumn("place_key", F.struct(*order))
    steps = keyed.groupBy("claim_id", "edition").agg(F.array_sort(F.collect_list(F.struct("place_key", creator.alias("names")))).alias("steps"))

    def step(acc: Column, s: Column) -> Column:
        first = F.size(acc["kept"]) == 0
        new = first | (s["names"].isNotNull() & ~acc["unsigned"] & ~F.arrays_overlap(s["names"], acc["seen"]))
        seen = F.when(new, F.array_union(acc["seen"], F.coalesce(s["names"], acc["none"]))).otherwise(acc["seen"])
        kept = F.concat(acc["kept"], F.filter(F.array(s["place_key"]), lambda _: new))
        # A kept lead without a creator is any creator's.
        return F.struct(kept.alias("kept"), seen.alias("seen"), (acc["unsigned"] | (new & s["names"].isNull())).alias("unsigned"), acc["none"].alias("none"))

    none = F.array().cast("array<string>")
    start = F.struct(F.slice(F.transform("steps", lambda x: x["place_key"]), 1, 0).alias("kept"), none.alias("seen"), F.lit(False).alias("unsigned"), none.alias("none"))
    kept = steps.select("claim_id", "edition", F.explode(F.aggregate("steps", start, step, lambda acc: acc["kept"])).alias("place_key"))
    return keyed.join(kept, ["claim_id", "edition", "place_key"], "left_semi").select(*leads.columns)


def ranked(hits: DataFrame, claims: DataFrame, least: float = 0.3) -> DataFrame:
    """claim_id, place, identifier, score, matched, text: readable books by their best passage, open before lent, one a work."""
    judged = judged_passages(hits, claims).where(F.col("reason").isNull() & (F.col("score") >= least))
    best = judged.groupBy("claim_id", "identifier", "rank", "access").agg(F.min_by(F.struct("score", "matched", "text"), F.struct((-F.col("score")).alias("s"), "pos")).alias("b"))
    rows = best.select("claim_id", "identifier", "rank", "access", "b.*").join(hits.select("claim_id", "rank", "identifier", "title", "creator"), ["claim_id", "rank", "identifier"])
    rows = rows.withColumn("down", -F.col("score")).withColumn("lent", (F.col("access") == "borrow").cast("int"))
    kept = one_per_work(rows, ["down", "lent", "rank"])
    return numbered(kept, ["claim_id"], [F.col("down"), F.col("lent"), F.col("rank")], "place").drop("down", "lent")


def ranked_by_units(hits: DataFrame, claims: DataFrame, most: int = 3) -> DataFrame:
    """Books by the parts of the claim in their best passage: two, one of them strong, and a word of the subject."""
    rows = gated(hits).where("gate.ok").join(claims.select("claim_id", "claim", C.subject_of(F.col("article_title")).alias("subject")), "claim_id")
    # Titles do not go along with every passage: a book is known by a hash of them.
    book = F.xxhash64("title", "creator").alias("book")
    rows = rows.withColumn("about", title_is_about(F.col("title"), F.col("subject"))).withColumn("own", C.tokens(F.col("subject")))
    rows = rows.select("claim_id", "identifier", book, "rank", "claim", "subject", "about", "own", F.posexplode("highlights").alias("pos", "text"))
    rows = rows.where(F.col("about") | (F.size("own") == 0) | F.arrays_overlap("own", C.tokens(F.col("text"))))

    def make(r) -> tuple:
        units, about = words.claim_units(r.claim, r.subject, 6, False)
        held = words.units_in(r.text, units, about)
        ok = len(held) >= 2 and any(u.strong for u in held)
        return (len(held) if ok else 0), (words.rounded(len(held) / len(units)) if ok else 0.0), [u.key for u in held]

    keep = ["claim_id", "identifier", "book", "rank", "pos", "text"]
    scored = _each(rows, keep, "n int, score double, matched array<string>", make).where("n > 0")
    best = scored.groupBy("claim_id", "identifier", "book", "rank").agg(F.min_by(F.struct("n", "score", "matched", "text"), F.struct((-F.col("n")).alias("m"), "pos")).alias("b"))
    top = settled(top_k(best.select("claim_id", "identifier", "book", "rank", "b.*"), ["claim_id"], [F.desc("n"), F.col("rank")], most, "place"))
    keys = ["claim_id", "identifier", "book", "rank"]
    named = hits.select("claim_id", "identifier", book, "rank", "title", "creator").join(small(top), keys).dropDuplicates(keys)
    return named.select("claim_id", "identifier", "title", "creator", "rank", "n", "score", "matched", "text", "place")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two rankings (claim_id, place, identifier, title, creator, ...) taken in turn, one book a work."""
    both = first.withColumn("which", F.lit(0)).unionByName(second.withColumn("which", F.lit(1)), allowMissingColumns=True)
    return numbered(one_per_work(both, ["place", "which"]), ["claim_id"], [F.col("place"), F.col("which")], "turn")


def planned(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """Books found by a plan's queries (column query_no), by how many of its concepts their passages mention.

    ``plans``: claim_id, terms (array of arrays of wordings).  A book needs two concepts in one passage and, if the plan names anyone, a name.
    Its passages come by how many concepts they mention.
    """
    own = gated(hits).where("gate.ok")
    book = own.groupBy("claim_id", "identifier").agg(
        F.min(F.struct("rank", "query_no")).alias("first"), F.min_by(F.struct("title", "creator", "year", "file", F.col("gate.access").alias("access")), F.struct("rank", "query_no")).alias("hit"), F.array_sort(F.collect_list(F.struct("rank", "query_no", "highlights"))).alias("found")
    )
    passages = F.array_distinct(F.flatten(F.transform("found", lambda x: x["highlights"])))
    book = book.withColumn("passages", passages).where(F.size("passages") > 0).join(plans.where(F.size("terms") >= 2), "claim_id")
    whole = F.array_join("passages", " ")
    most = F.array_max(F.transform("passages", lambda p: C.plan_coverage(p, F.col("terms"))))
    names = C.name_concepts(F.col("terms"))
    kept = book.withColumn("cover", C.plan_coverage(whole, F.col("terms"))).where((most >= 2) & ((F.size(names) == 0) | (C.plan_coverage(whole, names) > 0)))
    order = [F.desc("cover"), F.col("first")]
    by_cover = F.array_sort(F.transform("passages", lambda p, i: F.struct((-C.plan_coverage(p, F.col("terms"))).alias("down"), i.alias("i"), p.alias("p"))))
    passages = F.transform(by_cover, lambda x: x["p"]).alias("passages")
    out = kept.select("claim_id", "identifier", "hit.*", "cover", C.js_round(F.col("cover") / F.size("terms")).alias("score"), "first", passages)
    return numbered(out, ["claim_id"], order, "place")


def best_windows(texts: DataFrame, claims: DataFrame, key: str = "identifier") -> DataFrame:
    """The stretch of each book text (claim_id, key, text) that holds most of its claim."""
    rows = texts.join(claims.select("claim_id", "claim", "article_title"), "claim_id")

    def make(r) -> tuple:
        return words.best_window(r.text or "", r.claim, r.article_title) or (None, None, [])

    return _each(rows.select("claim_id", key, "text", "claim", "article_title"), ["claim_id", key], "window string, score double, matched array<string>", make)


def located(texts: DataFrame, claims: DataFrame, key: str = "identifier", most: int = 2) -> DataFrame:
    """claim_id, key, place, stretch: the best stretches of each whole book text for its claim's concepts.

    texts: claim_id, key, text; claims: claim_id, concepts (arrays of wordings).  Texts stay where they are if the claims are few: many may have one claim.
    """
    rows = texts.join(small(settled(claims.select("claim_id", "concepts"))), "claim_id").where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [words.locate(t, [list(g) for g in c], most) for t, c in zip(b["text"], b["concepts"], strict=True)]
            yield pd.DataFrame({"claim_id": b["claim_id"], key: b[key], "stretches": found})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("claim_id", key))
    out = rows.select("claim_id", key, "text", "concepts").mapInPandas(run, f"{kinds}, stretches array<string>")
    return out.select("claim_id", key, F.posexplode("stretches").alias("place", "stretch"))


def evidence(passages: Column, windows: Column, most: int = 3000) -> Column:
    """What a judge reads of a book: its passages, the first ``most`` characters of them together, and its windows, ruled off."""
    first = F.left(F.array_join(passages, "\n…\n"), F.lit(most))
    return F.array_join(F.filter(F.concat(F.array(first), windows), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n---\n\n")


def overlapping(texts: DataFrame, keys: list[str], length: int, over: int) -> DataFrame:
    """keys, part, text: ``texts`` (keys, text) cut into parts of ``length`` characters, each with up to ``over`` more that the next part begins with.

    A place is found by counting characters from a text's start, so long texts are cut in two steps: large parts, then parts of those.
    """
    large = max(1, (1 << 20) // length) * length
    pieces = F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(large)).cast("int") - 1)
    first = texts.where(F.length("text") > 0).select(*keys, "text", F.explode(pieces).alias("big"))
    first = first.select(*keys, "big", F.substring("text", F.col("big") * large + 1, F.lit(large + over)).alias("piece"), (F.length("text") <= (F.col("big") + 1) * large).alias("final"))
    # The last large part has its end to itself; in all others the overlap belongs to the next one.
    ends = F.when(F.col("final"), F.length("piece")).otherwise(F.lit(large))
    count = F.greatest(F.ceil(ends / F.lit(length)), F.lit(1)).cast("int")
    second = first.select(*keys, "big", "piece", F.explode(F.sequence(F.lit(0), count - 1)).alias("small"))
    part = (F.col("big").cast("long") * (large // length) + F.col("small")).alias("part")
    return second.select(*keys, part, F.substring("piece", F.col("small") * length + 1, F.lit(length + over)).alias("text"))


def collapse_copies(leads: DataFrame, least: int = 80) -> DataFrame:
    """Leads (claim_id, place, identifier, bundled, passages) of which no two share a passage of ``least`` characters or more, and their slot.

    In order of place; a book of its own takes the slot of one in a bundle, and is what later leads are held against.  Which texts meet is
    found by an exchange on the passages' keys; only a claim's leads that share one go through the fold, and only by their keys.
    """
    keyed = leads.withColumn("keys", F.array_distinct(F.filter(F.transform("passages", C.copy_key), lambda k: F.length(k) >= least)))
    met = keyed.select("claim_id", "place", F.explode("keys").alias("key")).groupBy("claim_id", "key").agg(F.count("*").alias("n"), F.collect_set("place").alias("places"))
    places = met.where("n > 1").select("claim_id", F.explode("places").alias("place")).distinct()
    alone = leads.join(places, ["claim_id", "place"], "left_anti").select(*leads.columns, F.col("place").alias("slot"))
    together = keyed.join(places, ["claim_id", "place"], "left_semi")
    lists = together.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("slot"), "place", "bundled", "keys"))).alias("leads"))

    def step(shown: Column, x: Column) -> Column:
        twin = F.array_position(F.transform(shown, lambda o: F.arrays_overlap(o["keys"], x["keys"])), True)

        def put(k: Column) -> Column:
            mine = lambda o: F.struct(o["slot"].alias("slot"), x["place"].alias("place"), x["bundled"].alias("bundled"), x["keys"].alias("keys"))
            other = F.transform(shown, lambda o, i: F.when((i + 1 == k) & o["bundled"] & ~x["bundled"], mine(o)).otherwise(o))
            return F.when(k == 0, F.concat(shown, F.array(x))).otherwise(other)

        return C.bound(twin, put)

    kept = lists.select("claim_id", F.explode(F.aggregate("leads", F.slice("leads", 1, 0), step)).alias("x")).select("claim_id", "x.place", "x.slot")
    return alone.unionByName(together.join(kept, ["claim_id", "place"]).select(*alone.columns))


def details_url(identifier: Column, book: Column) -> Column:
    """The page of an item, or of one book of a bundle."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat_ws("/", F.lit("https://archive.org/details"), encoded(identifier), encoded(book))


def book_citation(hits: DataFrame) -> Column:
    """The citation of a hit (title, creator, year, identifier, access, publisher, isbn, book): a bundle's own data are not its book's."""
    bars = C.escape_pipes
    item = F.col("book").isNull()
    creator = F.trim(F.regexp_replace("creator", LIFE_DATES, ""))
    part = lambda name, value, when: F.when(when & value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))
    url = details_url(F.col("identifier"), F.col("book"))
    body = F.concat_ws(
        " |", F.lit("cite book"), F.concat(F.lit("title="), bars(F.coalesce("book", "title"))), part("author", bars(creator), item), part("publisher", bars(F.col("publisher")), item),
        part("year", F.col("year").cast("string"), item), part("isbn", bars(F.col("isbn")), item), F.concat(F.lit("url="), url),
        F.when(F.col("access") == "borrow", "url-access=registration"), F.lit("via=Internet Archive"),
    )
    return F.concat(F.lit("{{"), body, F.lit("}}"))


