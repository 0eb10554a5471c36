"""Cited books of an article, and the catalogue search against a plain one."""

import random

import regex as re

from attestry.functions import markup as M
from attestry.operators import cited

ARTICLE = """Lead {{cite book |title=The [[Mill]] Book |last=Green |isbn=978-0-14-044913-6 |publisher=House}}.
== History ==
Text.{{sfn|Brown|1990|p=3}} More {{citation |title=Only a page |url=x}} {{Citation | title = Wheels | author = Lee, Ann | publisher=P {{nobr|x}} }}
=== Deeper ===
{{cite book|title=the mill book|last=Other}}
== Later ==
{{cite book |title=Far |last= |last1=Brown, John |isbn=}} {{cite web|title=No}}"""


def test_cited_books():
    plain = [("The Mill Book", "Green", "9780140449136", False), ("Wheels", "Lee, Ann", None, False), ("Far", "Brown, John", None, False)]
    assert M.cited_books(ARTICLE, None) == plain
    near = M.cited_books(ARTICLE, "History")
    assert [(b[0], b[3]) for b in near] == [("Wheels", True), ("Far", True), ("The Mill Book", False)]
    assert [(b[0], b[3]) for b in M.cited_books(ARTICLE, "Later")][0] == ("Far", True) and M.cited_books("", "x") == []


def test_rows_of_cited_books(spark):
    d = spark.createDataFrame([(1, ARTICLE, [None, "History"]), (2, None, ["x"]), (3, "none", [])], "article_id long, wikitext string, sections array<string>")
    got = sorted(cited.books(d, ["article_id"]).collect(), key=lambda r: (r["section"] or "", r["place"]))
    assert [(r["article_id"], r["section"], r["title"], r["in_section"]) for r in got][:1] == [(1, None, "The Mill Book", False)] and len(got) == 6


def test_found_equals_a_plain_search(spark):
    rng = random.Random(1)
    pool = ["history", "History", "mill", "Étude", "river", "stones", "old", "a", "lighthouse", "years"]
    title = lambda: " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))
    items = [(f"i{k}", k % 90, title(), rng.choice(["Green, Tom", "Ann Lee", None]), rng.choice([None, "9780140449136", "0-14-044913-X"])) for k in range(200)]
    books = [(k, title(), rng.choice([None, "Lee", "green", "Nobody", "X"]), rng.choice([None, None, "978-0-14-044913-6", "bad"])) for k in range(150)] + [(500, None, None, None)]
    i = spark.createDataFrame(items, "identifier string, place int, title string, creator string, isbn string")
    b = spark.createDataFrame(books, "book_id long, title string, last string, isbn string")
    parts = lambda t: [w for w in re.split(r"[^\p{L}\p{N}]+", (t or "").lower().replace("é", "e")) if w]
    digits = lambda x: (d := re.sub("[^0-9X]", "", (x or "").upper())) if re.fullmatch("[0-9]{9}[0-9X]|[0-9]{13}", re.sub("[^0-9X]", "", (x or "").upper())) else None  # noqa: E731, F841
    want = {}
    for k, t, last, isbn in books:
        own = [x for x in items if digits(isbn) and digits(x[4]) == digits(isbn)]
        via = "isbn"
        if not own:
            wanted, via = [w for w in parts(t) if len(w) > 3][:6], "title"
            who = last.lower() if last and len(last) > 2 else None
            own = [x for x in items if wanted and set(wanted) <= set(parts(x[2])) and (not who or who in parts(x[3]))]
        best = min(own, key=lambda x: (x[1], x[0]), default=None)
        want[k] = (best[0], via) if best else (None, None)
    got = {r["book_id"]: (r["identifier"], r["via"]) for r in cited.found(b, i).collect()}
    assert got == want and {v for _, v in want.values()} == {"isbn", "title", None}
    named = spark.createDataFrame([(1, "The Mill", "Tom Green"), (2, "The Mill", "Tom Nobody"), (3, "a", None), (4, "Lighthouse", None)], "book_id long, title string, author string")
    told = {r["book_id"]: r["known"] for r in cited.known(named, i).collect()}
    there = lambda w, who: any(w in parts(x[2]) and (who is None or who in parts(x[3])) for x in items)
    assert told == {1: there("mill", "green"), 2: False, 3: False, 4: there("lighthouse", None)}


def test_copies_are_one_item_and_postings_are_cut(spark, monkeypatch):
    monkeypatch.setattr(cited, "BLOCK", 4)
    items = [(f"i{k}", k, "Old River Mill" if k % 2 else f"Mill River {k // 20}", "Ann Lee" if k % 3 else None) for k in range(200)]
    books = [(k, "river mill" if k < 100 else f"river {'old' if k % 2 else 'mill'}", "Lee" if k % 2 else None, None) for k in range(150)]
    i = spark.createDataFrame([(*x, None) for x in items], "identifier string, place int, title string, creator string, isbn string")
    b = spark.createDataFrame(books, "book_id long, title string, last string, isbn string")
    assert cited.index(i).count() == len({(x[2], x[3]) for x in items})
    got = {r["book_id"]: r["identifier"] for r in cited.found(b, i).collect()}
    for k, title, last, _ in books:
        want = [w for w in title.split() if len(w) > 3]
        own = [x for x in items if set(want) <= set(x[2].lower().split()) and (not last or x[3])]
        assert got[k] == min(own, key=lambda x: x[1])[0]
