"""Books that articles cite, looked up in a catalogue: by their ISBN, else by all words of the title and a name.

The catalogue is an inverted index of title words.  A search is a conjunction, so it goes through the postings of its rarest word only, and what it
finds there is held against the other words: frequent words have long postings, and no search needs to read them.  Postings hold an item's number and
a bitmap of its words only; what the bitmap lets through is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import markup
from .articles import _rows
from .joins import settled, small

#: How many words of a title are searched for, and to tell if a book is there at all.
TITLE_WORDS, KNOWN_WORDS = 6, 5
#: 64-bit words of the bitmap that rules items out before they are read, and how many items of a posting a task takes at once.
MARKS, BLOCK = 4, 4096


def books(articles: DataFrame, keys: list[str], sections: str = "sections", text: str = "wikitext") -> DataFrame:
    """A row for every book that an article (text, and the ``sections`` asked about) cites: section, place, title, last, isbn, in_section.

    For each section (null: none) books that it cites come first; of books with one title the first template counts.
    """
    packed = articles.withColumn("__both", F.to_json(F.struct(F.col(text).alias("text"), F.transform(F.col(sections), lambda s: F.coalesce(s, F.lit(""))).alias("sections"))))

    def make(both: str) -> Iterator[tuple]:
        import json

        given = json.loads(both)
        for section in given.get("sections", []):
            for k, b in enumerate(markup.cited_books(given.get("text", ""), section or None)):
                yield section or None, k, *b

    return _rows(packed, keys, "__both", "section string, place int, title string, last string, isbn string, in_section boolean", make)


def _parts(text: Column) -> Column:
    return F.filter(F.split(C.fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _terms(words: Column, names: Column) -> Column:
    """Hashes of words, and of names apart from these."""
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.transform(names, lambda w: F.xxhash64(w, F.lit("name"))))


def _marks() -> list[Column]:
    """mark0, mark1, ...: 64 bits each in which every hash of ``terms`` sets one; a set that holds another has all of its bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(8)).bitwiseAND(F.lit(63)).cast("int"))
    one = lambda k: F.aggregate("terms", F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.when(h.bitwiseAND(F.lit(MARKS - 1)) == k, bit(h)).otherwise(F.lit(0).cast("long"))))
    return [one(k).alias(f"mark{k}") for k in range(MARKS)]


def index(items: DataFrame) -> DataFrame:
    """item, place, identifier, words, names, terms and bitmaps of a catalogue (identifier, place, title, creator): of items with the same words and names, the first."""
    sorted_ = lambda c: F.array_sort(F.array_distinct(_parts(F.col(c))))
    own = items.select(F.struct("place", "identifier").alias("at"), sorted_("title").alias("words"), sorted_("creator").alias("names"))
    once = own.groupBy("words", "names").agg(F.min("at").alias("at")).where(F.size("words") > 0)
    own = once.select(F.monotonically_increasing_id().alias("item"), "at.place", "at.identifier", "words", "names", _terms(F.col("words"), F.col("names")).alias("terms"))
    # Bitmaps are made before terms are rows: made with these, they would be made again for each.
    return settled(own.select("*", *_marks()))


def needed(title: Column, most: int = TITLE_WORDS) -> Column:
    """The words of a title that a search is for: the first ``most`` of four letters or more."""
    return F.array_distinct(F.slice(F.filter(_parts(title), lambda w: F.length(w) > 3), 1, most))


def first_matches(asked: DataFrame, items: DataFrame, by: str = "book_id") -> DataFrame:
    """by, place, identifier: the first item that a search for all ``words`` and, if there is one, the name ``who`` finds.  No words find nothing.

    Searches that ask the same are one, and so are items that say the same, as copies would meet each other in pairs.
    """
    catalogue = index(items)
    each = asked.where(F.size("words") > 0).select(by, F.array_sort("words").alias("wanted"), "who")
    who = F.when(F.col("who").isNull(), F.array().cast("array<string>")).otherwise(F.array("who"))
    once = each.select("wanted", "who").distinct().select(F.monotonically_increasing_id().alias("search"), "wanted", "who", _terms(F.col("wanted"), who).alias("terms"))
    searches = settled(once.select("*", *_marks()))
    marks = [f"mark{k}" for k in range(MARKS)]
    postings = catalogue.select("item", *marks, F.explode("terms").alias("term"))
    counts = catalogue.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # A term that no item has makes the search empty; of the others the rarest is looked up.
    ranks = searches.select("search", F.explode("terms").alias("term")).join(counts, "term", "left")
    n = F.coalesce("n", F.lit(0))
    rarest = settled(ranks.groupBy("search").agg(F.min(F.struct(n.alias("n"), "term")).alias("r")).where("r.n > 0").select("search", "r.term", F.ceil(F.col("r.n") / BLOCK).cast("int").alias("blocks")))
    # Long postings are cut into blocks, so that no task has all of them.
    read = small(rarest.select("term", "blocks").distinct())
    postings = postings.join(read, "term").withColumn("block", F.pmod("item", "blocks").cast("int")).drop("blocks")
    rows = rarest.join(searches, "search").select("search", "wanted", "who", "term", *marks, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    l, r = rows.alias("l"), postings.alias("r")
    may = reduce(lambda a, b: a & b, (F.col(f"l.mark{k}").bitwiseAND(F.col(f"r.mark{k}")) == F.col(f"l.mark{k}") for k in range(MARKS)))
    met = l.join(r, (F.col("l.term") == F.col("r.term")) & (F.col("l.block") == F.col("r.block")) & may).select("search", "wanted", "who", "item")
    holds = (F.size(F.array_except("wanted", "words")) == 0) & (F.col("who").isNull() | F.array_contains("names", F.col("who")))
    hits = met.join(catalogue.drop("terms", *marks), "item").where(holds).groupBy("search").agg(F.min(F.struct("place", "identifier")).alias("at"))
    told = searches.select("search", "wanted", "who").join(hits, "search")
    same = told.select(F.col("wanted").alias("words_"), F.col("who").alias("who_"), "at.place", "at.identifier")
    return each.join(same, (F.col("wanted") == F.col("words_")) & F.col("who").eqNullSafe(F.col("who_"))).select(by, "place", "identifier")


def found(cited: DataFrame, items: DataFrame, by: str = "book_id") -> DataFrame:
    """``cited`` (by, title, last, isbn) with identifier and via (isbn, title or null): the first item of its ISBN, else of its title and name."""
    first = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct("place", "identifier")).alias("at")).select(key, "at.place", "at.identifier")
    numbered = first(items.select("place", "identifier", C.normalise_isbn(F.col("isbn")).alias("isbn")).where("isbn IS NOT NULL"), "isbn")
    by_isbn = settled(first(cited.select(by, C.normalise_isbn(F.col("isbn")).alias("isbn")).where("isbn IS NOT NULL").join(numbered, "isbn"), by))
    who = C.fold(F.element_at(F.split(F.col("last"), r"[,\s]"), 1))
    asked = cited.select(by, needed(F.col("title")).alias("words"), F.when(F.length(who) > 2, who).alias("who")).join(by_isbn, by, "left_anti")
    by_title = first(first_matches(asked, items, by), by)
    both = by_isbn.withColumn("via", F.lit("isbn")).unionByName(by_title.withColumn("via", F.lit("title"))).drop("place")
    return cited.join(both, by, "left")


def known(named: DataFrame, items: DataFrame, by: str = "book_id") -> DataFrame:
    """``named`` (by, title, author) with known: whether the catalogue has a book of such a title and name at all, readable or not."""
    surname = F.regexp_replace(C.fold(F.coalesce(F.element_at(F.split(F.trim("author"), r"\s+"), -1), F.lit(""))), r"[^\p{L}-]", "")
    asked = named.select(by, needed(F.col("title"), KNOWN_WORDS).alias("words"), F.when(F.length(surname) > 2, surname).alias("who"))
    hits = first_matches(asked, items, by).select(by).distinct().withColumn("known", F.lit(True))
    return named.join(hits, by, "left").withColumn("known", F.coalesce("known", F.lit(False)))
