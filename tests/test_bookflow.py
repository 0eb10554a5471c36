"""The book search against a plain loop over the same recordings."""

import json
import random
from collections import Counter

import regex as re
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.functions import words as W
from attestry.operators import bookflow as S
from attestry.operators import library as B
from attestry.plans import flows

NAMES = ["Mill", "Stone Bridge", "River Works", "Old Town", "Harbour Light", "Iron Gate"]
PEOPLE = ["Anna Brook", "John Stone", "Maria Field", "Peter Marsh", None, "", "Brook, Anna, 1850-1920"]


def _claims():
    return [
        (1, "The mill was built in 1861 by Thomas Greenfield and ground 300 tonnes of flour.", "Eastham Mill"),
        (2, "In 1889 the bridge carried 4,500 carts a day under Robert Ashdown.", "Stone Bridge (Eastham)"),
        (3, "Some people liked it very much.", "Harbour Light"),
        (4, "Working-class housing near the Iron Gate got Gothic details in 1902.", "Iron Gate"),
    ]


def _world(seed):
    """Recordings, plans and named books, with failures, repeats, bundles, several scans of a work and periodicals."""
    rng = random.Random(seed)
    claims = _claims()
    facts = [w for _, c, t in claims for w in (c + " " + t).replace(",", "").split()]

    def passage(claim):
        own = claim[1].replace(",", "").split() + claim[2].split()
        return " ".join(rng.choice(own if rng.random() < 0.75 else facts) for _ in range(rng.randrange(4, 26)))

    books = {}
    for k in range(60):
        collections = rng.choice([[], ["inlibrary"], ["printdisabled"], ["periodicals"], ["inlibrary", "printdisabled"]])
        title = rng.choice(["A ", "The ", ""]) + rng.choice(NAMES) + rng.choice([" history", ": a study", "", " of Eastham"])
        books[f"book{k}" + (".x" if k % 11 == 0 else "")] = {"title": title, "creator": rng.choice(PEOPLE), "year": str(rng.choice([1889, 1861, 1900])), "mediatype": rng.choice(["texts"] * 6 + ["audio"]), "collection": collections, "file_basename": rng.choice([None, "a", "b"])}
    shared = [passage(c) for c in claims for _ in range(2)]

    def fields(i):
        return {"identifier": i} | {k: v for k, v in books[i].items() if v is not None}

    def search(claim, size):
        hits = []
        for i in rng.sample(sorted(books), size):
            texts = [rng.choice(shared) if rng.random() < 0.3 else passage(claim) for _ in range(rng.randrange(4))]
            hits.append({"fields": fields(i), "highlight": {"text": texts if len(texts) != 1 else texts[0]}})
        return json.dumps({"response": {"body": {"hits": {"hits": hits}}}})

    records, plans, named = [], [], []
    for claim in claims:
        t = W.claim_terms(claim[1], claim[2])
        for q in W.archive_queries(t)[: S.ARCHIVE_QUERIES] + W.phrase_queries(t)[: S.PHRASE_QUERIES]:
            lost = rng.random()
            if lost > 0.2:
                records.append(("search", q, search(claim, rng.randrange(8)), None))
            elif lost > 0.1:
                records.append(("search", q, None, "HTTP 500"))
        terms = [[w, w + "s"] for w in rng.sample(claim[1].replace(",", "").replace(".", "").split(), 4)] if claim[0] != 3 else [["liked"]]
        queries = [f"plan {claim[0]} {k}" for k in range(3)]
        plans.append((claim[0], ("fact", queries, terms)))
        records += [("search", q, search(claim, rng.randrange(3, 14)), None) for q in queries[:2]]
        for seq in range(4):
            title, author = rng.choice(NAMES), rng.choice(["Anna Brook", "Lee", None])
            named.append((claim[0], seq, title, author, 1900))
    d = {}
    for claim_id, seq, title, author, _ in named:
        q = f"title:({' AND '.join(title.split())})" + (f" AND creator:({author.split()[-1]})" if author and len(author.split()[-1]) > 2 else "")
        d[q] = json.dumps({"response": {"docs": [fields(i) for i in rng.sample(sorted(books), 5)]}})
    records += [("catalogue", q, b, None) for q, b in d.items()]
    for i in books:
        if rng.random() < 0.8:
            md = {"publisher": ["House", "Other"], "isbn": "123"} | ({"access-restricted-item": "true"} if rng.random() < 0.2 else {})
            records.append(("metadata", i, json.dumps({"metadata": md, "is_dark": rng.random() < 0.1, "files": [{"name": n} for n in rng.choice([["a_djvu.txt"], ["a_djvu.txt", "b_djvu.txt"], ["x.pdf"]])]}), None))
        for f in (i, "a", "b"):
            if rng.random() < 0.7:
                body = " ".join(passage(rng.choice(claims)) + " filler words here" for _ in range(rng.randrange(1, 90)))
                records.append(("text", f"{i}/{f}", f"<html><pre>{body}</pre>" if rng.random() < 0.9 else "<html>none", None))
    return claims, records, plans, named, search, rng


class Plain:
    """One claim after the other, one step after the other."""

    def __init__(self, records, passages, shelf):
        self.get = {(k, key): (body, error) for k, key, body, error in records}
        self.matched = passages  # (text, terms) to the concepts mentioned, by the function that a query checks
        self.shelf = shelf

    def ask(self, kind, key):
        body, error = self.get.get((kind, key), (None, None))
        return body, (None if body is not None else error or "no recording")

    @staticmethod
    def hits(body):
        out = []
        for h in json.loads(body)["response"]["body"]["hits"]["hits"]:
            f = h["fields"]
            texts = h["highlight"]["text"]
            out.append(Plain.hit(f, [texts] if isinstance(texts, str) else texts))
        return out

    @staticmethod
    def hit(f, texts):
        lent = bool({"inlibrary", "lendinglibrary"} & set(f["collection"]))
        reason = "not a text" if f["mediatype"] != "texts" else "print-disabled readers only" if not lent and "printdisabled" in f["collection"] else None
        return {"id": f["identifier"], "title": f["title"], "creator": f.get("creator"), "year": int(f["year"]), "file": f.get("file_basename"), "periodical": "periodicals" in f["collection"], "texts": [t.strip() for t in texts if t.strip()], "reason": reason, "access": None if reason else "borrow" if lent else "open"}

    @staticmethod
    def same(a, b):
        key = lambda t: [w for w in re.sub(r"[^\p{L}\p{N} ]+", " ", W.fold(re.split(r"\s*[:;]\s*", t)[0])).split() if w not in ("the", "a", "an")][:8]
        who = lambda c: set(W.token_set(re.sub(B.LIFE_DATES, "", c)))
        return key(a["title"]) == key(b["title"]) and (not a["creator"] or not b["creator"] or bool(who(a["creator"]) & who(b["creator"])))

    def run(self, claim, plan, named, full_text):
        cid, text, title = claim
        t, subject = W.claim_terms(text, title), W.subject_of(title)
        funnel = {"rejected": Counter(), "dropped": Counter(), "errors": [], "queries": []}
        books = {}
        for family in (W.archive_queries(t)[: S.ARCHIVE_QUERIES], W.phrase_queries(t)[: S.PHRASE_QUERIES]):
            own = {}
            for q in family:
                funnel["queries"].append(q)
                body, error = self.ask("search", q)
                if error:
                    funnel["errors"].append(f"search failed: {error}")
                for h in self.hits(body) if body else []:
                    own.setdefault(h["id"], h)
                if len(own) >= S.ENOUGH:
                    break
            for i, h in own.items():
                books.setdefault(i, h)
        hits = list(books.values())
        for n, h in enumerate(hits):
            h["rank"] = n
            funnel["rejected"][h["reason"]] += 1
        ok = [h for h in hits if not h["reason"]]
        funnel |= {"hits": len(hits), "available": len(ok), "borrowable": sum(h["access"] == "borrow" for h in ok)}
        scored = []
        about = set(W.token_set(subject))
        for h in ok:
            named_so = bool(about) and about <= set(W.token_set(h["title"]))
            found = []
            for p in h["texts"]:
                score, matched, reason = W.judge_passage(p, text, subject, named_so, str(h["year"]) if h["periodical"] else None)
                reason = reason or ("below threshold" if score < 0.3 else None)
                funnel["dropped"][reason] += 1
                if not reason:
                    found.append((p, score, list(matched)))
            if found:
                found.sort(key=lambda x: -x[1])
                scored.append((h, found, found[0][1]))
        scored.sort(key=lambda s: (-s[2], s[0]["access"] != "open", s[0]["rank"]))
        funnel["matched"] = len(scored)

        def one_a_work(leads):
            out = []
            for s in leads:
                if not any(self.same(o["hit"], s["hit"]) for o in out):
                    out.append(s)
            return out

        lead = lambda h, passages, score: {"hit": h, "passages": passages, "score": score, "full": False, "via": None}
        first = one_a_work([lead(*s) for s in scored])
        units, words_of = W.claim_units(text, subject, 6, False)
        second = []
        for h in ok:
            best = None
            named_so = bool(about) and about <= set(W.token_set(h["title"]))
            for p in h["texts"]:
                if not named_so and about and not about & set(W.token_set(p)):
                    continue
                held = W.units_in(p, units, words_of)
                if len(held) >= 2 and any(u.strong for u in held) and (best is None or len(held) > len(best[1])):
                    best = (p, held)
            if best:
                score = W.rounded(len(best[1]) / len(units))
                second.append(lead(h, [(best[0], score, [u.key for u in best[1]])], score))
        second = sorted(second, key=lambda s: (-len(s["passages"][0][2]), s["hit"]["rank"]))[:3]
        funnel["by_units"] = len(second)
        turns = [s for k in range(max(len(first), len(second))) for s in (*first[k : k + 1], *second[k : k + 1])]
        short = one_a_work(turns)[: S.CANDIDATES + S.SPARES]
        extras = []
        if full_text:
            rest = [h for h in ok if h["access"] == "open" and not any(self.same(s["hit"], h) for s in short)]
            rest = [lead(h, [], 0.0) for k, h in enumerate(rest) if not any(self.same(o, h) for o in rest[:k])]
            funnel |= {"read": 0, "windows": 0}
            for s in ([s for s in short if s["hit"]["access"] == "open"] + rest)[: S.TEXTS]:
                body, error = self.ask("text", f"{s['hit']['id']}/{s['hit']['file'] or s['hit']['id']}")
                if error:
                    funnel["errors"].append(f"text {s['hit']['id']}: {error}")
                found = re.search(r"<pre>(.*?)</pre>", body or "")
                if not found:
                    continue
                funnel["read"] += 1
                window = W.best_window(" ".join(found[1].split()), text, title)
                if window:
                    funnel["windows"] += 1
                    s["passages"].insert(0, window)
                    s["score"], s["full"] = max(s["score"], window[1]), True
                    if s not in short:
                        extras.append(s)
        shown = []

        def look_up(leads, cap):
            n = 0
            for s in leads:
                if n >= cap:
                    break
                body, error = self.ask("metadata", s["hit"]["id"])
                s["books"] = []
                if error:
                    funnel["errors"].append(f"metadata {s['hit']['id']}: {error}")
                else:
                    d = json.loads(body)
                    reason = "withdrawn" if d["is_dark"] else "access restricted" if "access-restricted-item" in d["metadata"] and s["hit"]["access"] == "open" else None
                    if reason:
                        funnel["rejected"][reason] += 1
                        continue
                    s["books"] = [f["name"][:-9] for f in d["files"] if f["name"].endswith("_djvu.txt")]
                shown.append(s)
                n += 1

        look_up(short, S.CANDIDATES)
        look_up(extras, S.TEXT_LEADS)
        looked = len(short) + len(extras)
        if plan:
            added = self.librarian(cid, plan, named, t, shown, funnel)
            n = len(shown)
            look_up(added, S.LIBRARIAN_LEADS)
            funnel["added"] = len(shown) - n
            looked += len(added)
        out = []
        bundled = lambda s: len(s["books"]) > 1 and s["hit"]["file"] in s["books"]
        keys = lambda s: {k for p in s["passages"] if len(k := re.sub(r"[^\p{L}\p{N}]+", " ", W.fold(p[0])).strip()) >= 80}
        for s in shown:
            twin = next((k for k, o in enumerate(out) if keys(o) & keys(s)), None)
            if twin is None:
                out.append(s)
            else:
                funnel["rejected"][S.COPY] += 1
                if bundled(out[twin]) and not bundled(s):
                    out[twin] = s
        funnel |= {"looked_up": looked, "candidates": len(out)}
        return out, funnel

    def librarian(self, cid, plan, named, t, shown, funnel):
        _, queries, terms = plan
        matched = lambda text: list(self.matched[text, cid])
        lists = []
        for q in queries:
            body, error = self.ask("search", q)
            if error:
                funnel["errors"].append(f"search failed: {error}")
            lists.append(self.hits(body) if body else [])
        books = {}
        for k in range(max(map(len, lists))):
            for l in lists:
                if k < len(l):
                    h = books.setdefault(l[k]["id"], l[k] | {"texts": []})
                    h["texts"] += [x for x in l[k]["texts"] if x not in h["texts"]]
        telling = [g for g in terms if not any(re.search("[0-9]", w) for w in g) and any(w[0].isupper() for w in g)]
        names = {W.fold(g[0]) for g in telling}
        planned = []
        for h in books.values() if len(terms) >= 2 else []:
            if h["reason"] or not h["texts"]:
                continue
            own = sorted((x for x in h["texts"]), key=lambda x: -len(matched(x)))
            whole = set(self.shelf[cid, tuple(h["texts"])])
            if len(matched(own[0])) < 2 or names and not whole & names:
                continue
            planned.append((len(whole), {"hit": h, "passages": [(x, 0.0, matched(x)) for x in own], "score": W.rounded(len(whole) / len(terms)), "full": False, "via": "planner"}))
        planned = [s for _, s in sorted(planned, key=lambda x: -x[0])]
        funnel["planned"] = len(planned)
        found = []
        for _, _, title, author, _ in named:
            q = f"title:({' AND '.join(title.split())})" + (f" AND creator:({author.split()[-1]})" if author and len(author.split()[-1]) > 2 else "")
            body, _ = self.ask("catalogue", q)
            docs = [self.hit(f, []) | {"file": None} for f in json.loads(body)["response"]["docs"]]
            found.append([h for h in docs if not h["reason"] and "." not in h["id"]][: S.NAMED_SCANS])
        funnel["named_found"] = sum(bool(f) for f in found)
        taken = [s["hit"] for s in shown]
        new = lambda h: not any(x["id"] == h["id"] or self.same(x, h) for x in taken)

        def add(s, texts):
            known = {p[0] for p in s["passages"]}
            for x in texts:
                if x not in known:
                    known.add(x)
                    s["passages"].append((x, 0.0, matched(x)))

        added, n = [], 0
        for s in planned:
            for o in shown:
                if o["hit"]["id"] == s["hit"]["id"]:
                    add(o, [p[0] for p in s["passages"]])
            if n < S.PLANNER_LEADS and new(s["hit"]):
                added.append((s, None))
                taken.append(s["hit"])
                n += 1
        for g, scans in enumerate(found):
            fresh = [h for h in scans if new(h)]
            added += [({"hit": dict(h), "passages": [], "score": 0.0, "full": False, "via": "named"}, g) for h in fresh]
            taken += fresh
        everyone = shown + [s for s, _ in added]
        level = lambda g: 0 if any(re.search("[0-9]", w) for w in g) else 1 if any(w[0].isupper() for w in g) else 2
        given = [g[0] for g in sorted(terms, key=level)]
        ids = [s["hit"]["id"] for s in everyone if "." not in s["hit"]["id"]]
        inside, funnel["shelf_terms"] = {}, list(dict.fromkeys(given))[:3]
        funnel["shelf_queries"] = 0
        for term in funnel["shelf_terms"]:
            for k in range(0, len(ids), 20):
                funnel["shelf_queries"] += 1
                body, error = self.ask("search", f'"{term}" identifier:(' + " OR ".join(f'"{i}"' for i in ids[k : k + 20]) + ")")
                if error:
                    funnel["errors"].append(f"shelf search failed: {error}")
                for h in self.hits(body) if body else []:
                    inside.setdefault(h["id"], []).append(h)
        for s in everyone:
            hits = inside.get(s["hit"]["id"], [])
            if s["hit"]["file"] is None:
                s["hit"]["file"] = next((h["file"] for h in hits if h["file"] is not None), None)
            add(s, [x for h in hits if h["file"] is None or h["file"] == s["hit"]["file"] for x in h["texts"]])
        out, kept = [], set()
        for s, g in added:
            if not s["passages"] or g in kept and g is not None:
                continue
            kept.add(g)
            s["passages"].sort(key=lambda p: -len(p[2]))
            s["cover"] = (cid, tuple(p[0] for p in s["passages"]))
            cover = self.shelf.get(s["cover"])
            s["score"] = max(s["score"], W.rounded(len(cover) / len(terms))) if cover is not None else None
            out.append(s)
        return out


def _frames(spark, claims, records, plans, named):
    return (
        spark.createDataFrame(claims, "claim_id long, claim string, article_title string"),
        spark.createDataFrame(records, "kind string, key string, body string, error string"),
        spark.createDataFrame(plans, "claim_id long, plan struct<fact: string, queries: array<string>, terms: array<array<string>>>"),
        spark.createDataFrame(named, "claim_id long, seq int, title string, author string, year int"),
    )


def _same(got, want):
    funnel, found = got
    for row in found:
        cid = row["claim_id"]
        w = want[cid][1]
        counted = {k: row[k] for k in w if isinstance(w[k], int)}
        assert counted == {k: v for k, v in w.items() if isinstance(v, int)}, cid
        assert row["queries"] is None and not w["queries"] or row["queries"] == w["queries"]
        clean = lambda c: {k: v for k, v in c.items() if k and v}
        assert (row["rejected"] or {}) == clean(w["rejected"]) and (row["dropped"] or {}) == clean(w["dropped"])
        assert (row["errors"] or []) == sorted(w["errors"])
        own = [r for r in funnel if r["claim_id"] == cid]
        assert [r["identifier"] for r in own] == [s["hit"]["id"] for s in want[cid][0]]
        for r, s in zip(own, want[cid][0], strict=True):
            assert r["passages"] == [p[0] for p in s["passages"]] and r["full_text"] == s["full"] and r["via"] == s["via"]
            assert s["score"] is None or abs(r["score"] - s["score"]) < 1e-9
            book = s["hit"]["file"] if len(s["books"]) > 1 and s["hit"]["file"] in s["books"] else None
            assert r["title"] == (book or s["hit"]["title"]) and r["url"].endswith(s["hit"]["id"] + (f"/{book}" if book else ""))


def test_book_search_equals_a_plain_loop(spark):
    for seed in (1,):
        claims, records, plans, named, _, _ = _world(seed)
        c, r, *_ = _frames(spark, claims, records, plans, named)
        out, funnel = flows.book_search(c, r, full_text=True)
        got = out.orderBy("claim_id", "place").collect(), funnel.collect()
        plain = Plain(records, {}, {})
        _same(got, {x[0]: plain.run(x, None, None, True) for x in claims})
        assert sum(x["candidates"] for x in got[1]) >= 5 and any(x["windows"] for x in got[1])


def test_librarian_equals_a_plain_loop(spark):
    claims, records, plans, named, search, rng = _world(3)
    c, r, p, n = _frames(spark, claims, records, plans, named)
    # The shelf queries depend on the leads: a first run tells them, and half of them are then recorded.
    asked = []
    before = S.shelf_requests

    def heard(*a):
        out = before(*a)
        asked.extend(x["query"] for x in out.collect())
        return out

    S.shelf_requests = heard
    try:
        flows.book_search(c, r, p, n)
    finally:
        S.shelf_requests = before
    assert asked
    more = [("search", q, search(claims[k % 4], 30), None) for k, q in enumerate(sorted(set(asked))) if k % 3]
    records = records + more
    c, r, p, n = _frames(spark, claims, records, plans, named)
    out, funnel = flows.book_search(c, r, p, n)
    got = out.orderBy("claim_id", "place").collect(), funnel.collect()
    # Which concepts a text mentions is asked of the column function, which has tests of its own.
    texts = sorted({t for kind, _, b, _ in records if kind == "search" and b for h in Plain.hits(b) for t in h["texts"]})
    terms = p.select("claim_id", "plan.terms")
    mentioned = spark.createDataFrame([(t,) for t in texts], "text string").crossJoin(terms).select("text", "claim_id", C.plan_matched(F.col("text"), F.col("terms")).alias("m")).collect()
    of = {(x["text"], x["claim_id"]): x["m"] for x in mentioned}

    class Cover(dict):
        """Concepts of texts together: those of each, as no wording here is split between two texts."""

        def get(self, key, default=None):
            return self[key]

        def __missing__(self, key):
            return sorted({m for t in key[1] for m in of[t, key[0]]})

    plain = Plain(records, of, Cover())
    want = {x[0]: plain.run(x, dict(plans)[x[0]], [b for b in named if b[0] == x[0]], False) for x in claims}
    _same(got, want)
    assert {"planner", "named"} <= {x["via"] for x in got[0]} and all(x["shelf_terms"] == want[x["claim_id"]][1]["shelf_terms"] for x in got[1] if x["shelf_terms"])


def test_windows_of_long_texts(spark):
    """Parts and their overlaps give what a scan of the whole text does, also where runs go over a part's end."""
    rng = random.Random(4)
    claim, title = "The mill was built in 1861 by Thomas Greenfield and ground 300 tonnes of flour.", "Eastham Mill"
    key = "Eastham mill built in 1861 by Thomas Greenfield, 300 tonnes"
    texts = []
    for k in range(24):
        words = ["word" * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4000))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), key if k % 3 else "1861 Greenfield")
        texts.append((1, f"t{k}", " ".join(words)))
    texts += [(1, "none", ""), (1, "null", None), (1, "long", "x y " * 400_000 + key + " z" * 300_000 + key), (1, "at", "a" * 147 + " " + key * 3), (1, "many", (key + " ") * 700)]
    d = spark.createDataFrame(texts, "claim_id long, identifier string, text string")
    c = spark.createDataFrame([(1, claim, title)], "claim_id long, claim string, article_title string")
    want = {i: w for _, i, t in texts if i != "long" and t and (w := W.best_window(t, claim, title))}
    for part in (3, 64):
        got = {r["identifier"]: r["window"] for r in S.windows_of(d, c, part=part).collect()}
        long = got.pop("long")
        assert key in long["text"] and long["text"][0] == long["text"][-1] == "…"
        assert {i: (w["text"], w["score"], w["matched"]) for i, w in got.items()} == want and len(want) > 10


def test_overlapping_parts_make_the_text(spark):
    texts = [(k, "".join(chr(97 + (j * k) % 26) for j in range(n))) for k, n in enumerate((1, 9, 10, 11, 25, 1 << 20, (1 << 20) + 5, 2_100_003))] + [(98, ""), (99, None)]
    d = spark.createDataFrame(texts, "id int, text string")
    for length, over in ((10, 3), (9600, 300)):
        want = {(k, n): t[n * length : n * length + length + over] for k, t in texts if t for n in range(-(-len(t) // length))} if length > 10 else None
        rows = B.overlapping(d if want else d.where("length(text) < 100"), ["id"], length, over).collect()
        want = want or {(k, n): t[n * length : n * length + length + over] for k, t in texts if t and len(t) < 100 for n in range(-(-len(t) // length))}
        assert {(r["id"], r["part"]): r["text"] for r in rows} == want and len(rows) == len(want)
