"""Leads, books, checks and completions on small inputs."""

import json

from pyspark.sql import functions as F

from attestry.operators import catalogue, joins, library, replies, verdicts
from attestry.operators import evaluation as E
from attestry.plans import flows
from attestry.streaming import limits

from test_markup import MILL

MUEHLE = """Die '''Steinbachmühle''' steht bei [[Ostheim]].

Das Rad ist 12 Meter breit und treibt 35 Steine.<ref name="r">{{cite web |url=https://register.example.de/muehle |title=Mühlenregister}}</ref><ref>{{Internetquelle |url=https://bau.example.de/rad |titel=Räder |hrsg=Bauamt}}</ref>
"""
SUISHA = "水車は幅12メートルで、石臼35基を回した。<ref>{{cite web |url=https://suisha.example.jp/a |title=水車}}</ref>\n"


def _articles(spark, *sisters):
    a = spark.createDataFrame([(1, "en", "Stonebrook Mill", MILL)], "article_id long, lang string, title string, wikitext string")
    s = spark.createDataFrame([(1, 10 + k, lang, "t", text) for k, (lang, text) in enumerate(sisters)], "article_id long, sister_id long, lang string, title string, wikitext string")
    t = spark.createDataFrame([("Eastham", "de", "Ostheim")], "title string, lang string, foreign string")
    return flows.article_leads(a, s, t).orderBy("claim_seq", "rank").collect()


def test_same_article(spark):
    rows = _articles(spark)
    # The note's sentence is short, so its reference also stands behind the tagged sentence before it.
    assert [(r["claim_seq"], r["origin"], r["url"]) for r in rows] == [(k, "same-article", "https://register.example.org/mill") for k in (0, 1)]
    assert rows[0]["paste"] == '<ref name="reg" />'


def test_sister_editions(spark):
    rows = [r for r in _articles(spark, ("de", MUEHLE), ("ja", SUISHA)) if r["claim_seq"] == 0]
    assert rows[0]["origin"] == "sister-wiki" and rows[0]["url"] == "https://register.example.de/muehle" and sorted(rows[0]["matched"]) == ["12", "35"]
    assert {r["url"] for r in rows} >= {"https://bau.example.de/rad", "https://suisha.example.jp/a", "https://register.example.org/mill"}
    assert next(r for r in rows if "bau" in r["url"])["paste"] == "<ref>{{cite web |url=https://bau.example.de/rad |title=Räder |work=Bauamt}}</ref>"
    assert not [r for r in _articles(spark, ("ja", SUISHA)) if r["claim_seq"] == 1 and r["origin"] == "sister-wiki"]


def _reply(*books):
    hits = [
        {"fields": {"identifier": i, "title": t, "creator": [c] if c else None, "year": y, "mediatype": "texts", "collection": col}, "highlight": {"text": p}}
        for i, t, c, y, col, p in books
    ]
    return json.dumps({"response": {"body": {"hits": {"hits": hits}}}})


def test_books(spark):
    good = "The {{{tower}}} was finished in 1889 and is 300 metres high, we are told"
    body = _reply(
        ("a", "The tower: a history", "Sorel, G., 1843-1899", "1890", ["americana"], [good]),
        ("b", "The Tower", "G. Sorel", 1895, ["inlibrary", "printdisabled"], [good]),
        ("c", "Other", None, "1900", ["printdisabled"], [good]),
        ("d", "Guide", None, "1901", "americana", ["A tower of some kind stood there for so many years", good]),
    )
    r = spark.createDataFrame([(7, body)], "claim_id long, body string")
    hits = library.search_hits(r, ["claim_id"])
    assert [h["year"] for h in hits.orderBy("rank").collect()] == [1890, 1895, 1900, 1901]
    claims = spark.createDataFrame([(7, "The tower was finished in 1889 and is 300 metres high", "Tower")], "claim_id long, claim string, article_title string")
    ranked = library.ranked(hits, claims).orderBy("place").collect()
    assert [x["identifier"] for x in ranked] == ["a", "d"] and ranked[0]["score"] >= 0.9
    stats = library.passage_stats(library.judged_passages(hits, claims)).first()
    assert stats["seen"] == 4 and stats["dropped"] == {"no claim number": 1}
    units = library.ranked_by_units(hits, claims).orderBy("place").collect()
    assert [x["identifier"] for x in units] == ["a", "b", "d"]
    cols = ["claim_id", "place", "identifier", "title", "creator"]
    merged = library.merged(spark.createDataFrame(ranked).select(*cols), spark.createDataFrame(units).select(*cols))
    assert [x["identifier"] for x in merged.orderBy("turn").collect()] == ["a", "d"]
    plan = spark.createDataFrame([(7, [["1889"], ["Tower"], ["king"]])], "claim_id long, terms array<array<string>>")
    planned = library.planned(hits.withColumn("query_no", F.lit(0)), plan).orderBy("place").collect()
    assert [(x["identifier"], x["cover"], x["score"]) for x in planned] == [("a", 2, 0.67), ("b", 2, 0.67), ("d", 2, 0.67)]


def test_copies_and_citation(spark):
    text = "word " * 30
    rows = [(1, 1, "x", True, [text]), (1, 2, "y", False, [text.upper()]), (1, 3, "z", False, ["short"]), (1, 4, "v", False, ["short"])]
    df = spark.createDataFrame(rows, "claim_id long, place int, identifier string, bundled boolean, passages array<string>")
    assert sorted(r["identifier"] for r in library.collapse_copies(df).collect()) == ["v", "y", "z"]
    h = spark.createDataFrame([("id", "A | B", "Lee, Ann, 1850-1920", 1900, "borrow", "P", None, None)], "identifier string, title string, creator string, year int, access string, publisher string, isbn string, book string")
    assert h.select(library.book_citation(h).alias("c")).first()["c"] == "{{cite book |title=A {{!}} B |author=Lee, Ann |publisher=P |year=1900 |url=https://archive.org/details/id |url-access=registration |via=Internet Archive}}"
    d = spark.createDataFrame([(1, json.dumps({"metadata": {"publisher": ["P"], "access-restricted-item": "true"}, "is_dark": False, "files": [{"name": "a_djvu.txt"}, {"name": "b.pdf"}]}))], "k int, body string")
    assert library.item_details(d, ["k"]).first().asDict() == {"k": 1, "publisher": "P", "isbn": None, "dark": False, "restricted": True, "books": ["a"]}


def test_find(spark):
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    leads = spark.createDataFrame([(1, "http://a/x", "A", "same-article", 1), (2, "http://b/x", "B", "sister-wiki", 1)], "claim_id long, url string, title string, origin string, rank int")
    web = spark.createDataFrame([(1, "http://w/1", "W", "web", 1), (2, "http://b/x/", "B", "web", 1), (2, "http://w/2", "W", "web", 2)], leads.schema)
    said = spark.createDataFrame([(1, "http://a/x", "SUPPORTED", 90.0, "high"), (2, "http://w/2", "PARTIALLY SUPPORTED", 50.0, "medium")], "claim_id long, url string, verdict string, confidence double, reliability string")
    rows = flows.find(claims, leads, web, said).orderBy("claim_id", "place").collect()
    assert [(r["claim_id"], r["url"], r["verdict"]) for r in rows] == [(1, "http://a/x", "SUPPORTED"), (2, "http://w/2", "PARTIALLY SUPPORTED"), (2, "http://b/x", "SOURCE UNAVAILABLE")]


def test_outcomes(spark):
    rows = [(True, "no", None, None, "other"), (True, "same", "supports", False, "supports"), (True, "same", "unsupported", False, "unsupported"), (True, "partial", "unsupported", True, "part"), (True, None, None, None, "none"), (False, "same", None, None, "unchecked"), (True, "same", None, None, "same")]
    df = spark.createDataFrame(rows, "d boolean, f string, r string, t boolean, want string")
    assert df.where(verdicts.sister_outcome(F.col("d"), F.col("f"), F.col("r"), F.col("t")) != F.col("want")).count() == 0
    claim = "The quick brown fox jumps over the lazy dog near the river"
    one = spark.createDataFrame([("SUPPORTED", claim, f"It says: “{claim}”!")], "v string, c string, t string")
    assert one.select(verdicts.web_tier(F.col("v"), F.col("c"), F.col("t")).alias("x")).first()["x"] == "flag"


def test_replies(spark):
    df = spark.createDataFrame([(1, 'ok {"books": [{"title": "Life  of Q", "author": "Ann O\'Brien", "year": "1900"}, {"title": "x"}]} bye'), (2, "none")], "k int, text string")
    b = replies.books(df, ["k"]).collect()
    assert [(r["title"], r["author"], r["year"]) for r in b] == [("Life of Q", "Ann O'Brien", 1900)]
    q = spark.createDataFrame(b).select(replies.catalogue_query(F.col("title"), F.col("author")).alias("q")).first()["q"]
    assert q == "title:(Life) AND creator:(O'Brien)"
    s = spark.createDataFrame([(1, '{"suggestions": [{"url": "http://a", "verdict": "supported", "confidence": 140, "reliability": "?"}, {"title": "no url"}]}')], "k int, text string")
    r = replies.suggestions(s, ["k"]).collect()
    assert [(x["title"], x["verdict"], x["confidence"], x["reliability"]) for x in r] == [("http://a", "SUPPORTED", 100.0, "medium")]
    leads = spark.createDataFrame([(1, 1), (1, 2)], "k int, nth int")
    j = spark.createDataFrame([(1, '{"sentences": [{"id": "S2", "verdict": "Same", "why": "w"}, {"verdict": "maybe"}]}')], "k int, text string")
    assert [x["fact"] for x in replies.same_fact(j, leads, ["k"]).orderBy("nth").collect()] == [None, "same"]
    ids = spark.createDataFrame([(1, k, f"id{k}" if k else "a.b") for k in range(23)], "c int, seq int, identifier string")
    assert sorted(x["size"] for x in replies.shelf_queries(ids, ["c"], F.lit("t")).collect()) == [2, 20]


def test_catalogue(spark):
    item = [{"itemType": "book", "title": "The  Mill", "ISBN": ["9780140449136"], "author": [["Ann", "Lee"], ["", "County"]], "date": "1930", "url": "http://z"}]
    own = "{{cite book |title=mill |isbn=978-0-14-044913-6 |url=http://a |access-date=2026-01-01 |page=3}}"
    done = catalogue.complete(own, json.dumps(item))
    assert done == "{{cite book |last=Lee |first=Ann |last2=County |title=The Mill |date=1930 |isbn=9780140449136 |url=http://a |access-date=2026-01-01 |page=3}}"
    assert catalogue.complete(own, "not json") == own and catalogue.complete(own, json.dumps([{"itemType": "book", "title": "http://a"}])) == own
    assert catalogue.lookup(own) == "9780140449136" and catalogue.lookup("{{cite web|url=https://doi.org/10.1038/x}}") == "10.1038/x"
    assert catalogue.lookup("{{cite book|url=https://archive.org/details/x}}") is None and catalogue.lookup("{{box}}") is None


def test_evaluation_and_joins(spark):
    df = spark.createDataFrame([("Some title@1", 7), ("é😀", 3)], "s string, n int")
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ int.from_bytes(c.encode("utf-16-le")[:2], "little")) * 16777619 % 2**32
        return h
    assert [r["pick"] for r in E.seeded_index(df, "s", "n").collect()] == [fnv("Some title@1") % 7, fnv("é😀") % 3]
    keys = spark.createDataFrame([("https://h.org/p?b=2&a=1&format=json", "get", "x")], "u string, m string, b string")
    k = keys.select(E.request_key(F.col("u"), F.col("m"), F.col("b")).alias("k")).first()["k"]
    assert k.startswith("GET h.org/p?a=1&b=2#") and len(k) == len("GET h.org/p?a=1&b=2#") + 16
    budget = spark.createDataFrame([(1, 1, 900), (1, 2, 900), (1, 3, 10), (2, 1, 5000)], "g int, i int, size int")
    assert [(r["g"], r["i"]) for r in joins.within_budget(budget, ["g"], "i", F.col("size"), 1600).orderBy("g").collect()] == [(1, 1), (2, 1)]
    req = spark.createDataFrame([("a",), ("b",)], "key string")
    rec = spark.createDataFrame([("a", 200, "x")], "key string, status int, body string")
    assert {r["key"]: r["error"] for r in E.replayed(req, rec).collect()} == {"a": None, "b": "no recording"}


def test_streaming(spark, tmp_path):
    rows = [(k, f"2026-01-01 00:00:{k:02d}", "m") for k in range(0, 40, 10)]
    spark.createDataFrame(rows, "id int, ts string, model string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, model string").parquet(str(tmp_path / "in"))
    q = limits.windowed_calls(stream, ["model"], "ts", "20 seconds", "20 seconds").writeStream.format("memory").queryName("calls").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["calls"] for r in spark.table("calls").collect()) == [2, 2]
    batch = limits.recent_calls(spark.read.parquet(str(tmp_path / "in")), ["model"], "ts", 15, 1).orderBy("id").collect()
    assert [r["recent"] for r in batch] == [1, 2, 2, 2] and [r["allowed"] for r in batch] == [True, False, False, False]
