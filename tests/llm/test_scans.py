"""Secrets, pseudonyms, decontamination and quality against plain versions."""

import hashlib
import math
import random
import re
import zlib
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import decontaminate, pseudonyms, quality, secrets


def _plain_spans(text):
    out = []
    for n, (kind, pattern, group, least) in enumerate((
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    )):
        out += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_spans():
    rng = random.Random(0)
    bits = ["password", "ToKeN", "secret", "api_key", "apikey", "=", ":", " ", "'", '"', "a1b2c3d4e5f60718", "é", "漢", "😀", "AKIA", "ABCDEFGHIJKLMNOPQR", "x", "\n", "secretoken", "passwd", "ſecret", "akia"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randrange(30)))
        assert [s for s in secrets.spans(t) if s[0] in secrets.BASE] == _plain_spans(t), t
    assert secrets.spans(None) == secrets.spans("") == []


def test_secret_checksums():
    body = b"abcdefghijklmnopqrstuvwxyz0123"
    good = "ghp_" + body.decode() + secrets._crc62(body).decode()
    assert ("repo_token", 2, 42) in secrets.spans(f"x {good} y") and not secrets.spans(f"x {good[:-1]}! y")
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    assert all(s[0] != "repo_token" for s in secrets.spans(bad))
    s = "glsa_" + "Ab1" * 10 + "Zz"
    assert [x[0] for x in secrets.spans(f"{s}_{zlib.crc32(s.encode()):08x}")] == ["service_token"]


def test_secret_rows(spark, tmp_path):
    rows = [(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e"', 5), (2, None, 5), (2, None, 5), (None, "", 5), (4, "x" * 200000 + " password: hunter2hunter2", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secrets.query(spark, str(tmp_path)).collect()}
    assert secrets.scan(d.limit(0)).collect() == [] and secrets.scan(d).count() == 5
    assert got == {(1, 1, 0, 1, "assign:0:41,hex:9:41"), (2, 0, 0, 0, ""), (None, 0, 0, 0, ""), (4, 1, 0, 0, "assign:200001:200025")}


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PERSONAL = [
    "Call +1 (017) 555-7713, mail a.b@x.com or A.B@x.com. 1.2.3.4 and 999.1.1.1 on 2024-02-29, 2024-02-30; 29.02.2024",
    "4845168114407329 4929-3483-8514-6306 9807915762804490 +1 (017) 555-7713", None, "", "no 12 x", "4845168114407329" * 3,
    "at 1.2.3.4.5 and 12345-2024-01-01", "w " * 50000 + "1.2.3.4",
]


def test_pseudonyms(spark):
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PERSONAL)], "doc_id long, text string, pii_kinds int")
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymised(d, "k").collect()}
    assert rows[0]["pii_kinds"] == ["phone", "email", "email", "address", "date", "date"]
    a = rows[0]["text"]
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, mail (u[0-9a-f]{12}@x\.com) or \1\. [\d.]+ and 999\.1\.1\.1 on (\d{4}-\d\d-\d\d), 2024-02-30; \d\d\.\d\d\.\d{4}", a)
    iso, plain = re.search(r"on (\S+),", a)[1], a[-10:]
    assert iso == "-".join(plain.split(".")[::-1]) and iso != "2024-02-29"
    cards = [x for x in PERSONAL[1].split(" ")[:3]]
    for old, new in zip(cards, rows[1]["text"].split(" "), strict=False):
        assert _luhn(new) == _luhn(old) and (new != old) == _luhn(old) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)
    assert rows[1]["text"][-17:] == re.search(r"\+1 \(\d+\) [\d-]+", a)[0]
    assert [rows[k]["text"] for k in (2, 3, 4, 5, 6)] == PERSONAL[2:7] and rows[2]["pii_kinds"] == []
    assert not rows[7]["text"].endswith(" 1.2.3.4") and rows[7]["text"].startswith("w w ")
    assert pseudonyms.pseudonymised(d, "other").where("doc_id = 0").first()["text"] != a
    assert pseudonyms.pseudonymised(d.limit(0), "k").collect() == []


def test_dates_are_permuted(spark):
    """Dates of the years 1 to 9999 (every 17th here) have different ones' places, and near dates have near ones'."""
    days = (date(9999, 12, 31) - date(1, 1, 1)).days + 1
    assert days == 256 * 287 + 1801 * 1987
    at = spark.range(0, days, 17).select(F.col("id").cast("int").alias("a"), pseudonyms._other_day(F.col("id").cast("int"), F.lit("k")).alias("b"))
    near = lambda c: F.col(c).between(pseudonyms.NEAR_FROM, pseudonyms.NEAR_FROM + 256 * 287 - 1)
    told = at.agg(F.count_distinct("b").alias("n"), F.count_if(~F.col("b").between(0, days - 1)).alias("out"), F.count_if(near("a") != near("b")).alias("mixed")).first()
    assert told.asDict() == {"n": -(-days // 17), "out": 0, "mixed": 0} and date(1, 1, 1) + timedelta(pseudonyms.NEAR_FROM) == date(1900, 1, 1)


def test_old_and_late_dates_go_too(spark):
    text = "born 1899-12-31, died 31.12.1850, due 2150-01-01, 0001-01-01 and 9999-12-31, not 0000-01-01 or 1899-02-29"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = pseudonyms.pseudonymised(d, "k").collect()
    assert r["pii_kinds"] == ["date"] * 5 and r["text"].endswith("not 0000-01-01 or 1899-02-29")
    found = re.findall(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", r["text"])[:5]
    assert all(a != b for a, b in zip(found, re.findall(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", text), strict=False))
    assert all(date.fromisoformat(x if x[4] == "-" else "-".join(x.split(".")[::-1])) for x in found)


@pytest.mark.parametrize("text", ["x@" + "a." * 20_000 + "a", "x@" + "a" * 100_000 + ".org", "a" * 100_000 + "@x.org", "a@b." * 20_000 + "c", "1." * 30_000 + "1", "@" * 50_000, "1-" * 30_000, "(555) " * 20_000])
def test_long_runs_take_no_stack(spark, text):
    d = spark.createDataFrame([(1, text), (2, "mail a@b.org")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(d, "k").collect()}
    assert got[2]["pii_kinds"] == ["email"] and (got[1]["pii_kinds"] != ["email"] or got[1]["text"].split("@")[1] == text.split("@")[1])


@pytest.mark.parametrize("window", range(5, 13))
def test_masks_are_lossless(window):
    for k in range(decontaminate.substitutions(window) + 1):
        for changed in combinations(range(window), k):
            assert any(
                all(at + j not in changed for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for at in range(window - len(m) + 1)
            ), changed


def _holds(text, item):
    a, b = decontaminate.words(text), decontaminate.words(item)
    n = min(12, len(b))
    for at in range(len(a) - n + 1):
        for k in range(len(b) - n + 1):
            if sum(x == y for x, y in zip(a[at : at + n], b[k : k + n], strict=True)) >= n - decontaminate.substitutions(n):
                return True
    return False


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(rng.randrange(2, 30)))) for k in range(25)] + [(99, None), (None, "w1 w2 w3 w4 w5 w6"), (98, " ,.! "), (97, "zz"), (96, "w5 w6 w7 w8"), (96, "w5 w6 w7 w8")]
    docs = []
    for k in range(200):
        w = make(rng.randrange(0, 60))
        if k % 3 == 0:
            part = rng.choice(items[:25])[1].split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "zz"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((k, ", ".join(w).upper(), [1]))
    docs += [(500, None, None), (501, "", None), (502, items[4][1] + " x" * 100000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, leaked_items array<long>")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaked(d, b).collect()}
    want = {i: sorted({k for k, t in items if k is not None and t and decontaminate.words(t) and _holds(text, t)}) if text else [] for i, text, _ in docs if i != 502}
    assert {k: v for k, v in got.items() if k != 502} == want and sum(map(bool, want.values())) > 20
    waves = {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaked(d, b, wave_bytes=500).collect()}
    assert waves == got
    assert decontaminate.leaked(d.limit(0), b).collect() == []


def test_quality(spark):
    rng = random.Random(5)
    def good():
        return " ".join(rng.choice(["plain", "words", "of", "a", "text", "that", "reads"]) for _ in range(rng.randrange(20, 80))).capitalize() + "."
    def bad():
        return " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in good().split())
    docs = [(k, good() if k % 4 else bad(), 3) for k in range(800)] + [(900, None, 3), (901, "", 3), (902, "x" * 100000, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(800)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    rows = quality.scored(d, model).withColumn("held", quality.held_out()).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 800]
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held) >= 0.98 * len(held)
    assert len(model.pairs) > 0 and all(t.ndim == 2 for *_, t in model.pairs)
    kept = quality.scored(d, model, keep_text=True)
    assert kept.columns == ["doc_id", "text", "score", "predicted"]
    none = quality.train(d, labels.limit(0))
    assert {r["score"] for r in quality.scored(d, none).collect()} == {0.5}
    assert quality.scored(d.limit(0), model).collect() == []


def test_pair_terms_are_used():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in model.pairs)


def test_telephones_and_cards_wherever_they_stand(spark):
    """A telephone needs no space before it; a number beside a card does not hide the card, nor a card what is beside it."""
    phone, card = "555-123-4567", "4111111111111111"
    cases = [
        (phone, ["phone"]), (f"x\n{phone}", ["phone"]), (f"Tel:{phone}", ["phone"]), (f"\t{phone}\t", ["phone"]), (f"[{phone}]", ["phone"]), (f'"{phone}"', ["phone"]), (f"12 {phone} 89", ["phone"]),
        (f"item 12 {card}", ["card"]), (f"{card} 12", ["card"]), (f"12 34 56 78 {card} 9", ["card"]), ("1234 5678 9012 4111 1111 1111 1111 77", ["card"]), (f"{card} {card}", ["card", "card"]), (f"{card} {phone}", ["card", "phone"]),
        (f"{phone} {card}", ["phone", "card"]), (f"2024-01-02 {card} 2024-01-03", ["date", "card", "date"]), (f"10.0.0.1 {card} 10.0.0.2", ["address", "card", "address"]), (f"{card} 99@x.org", ["card", "email"]), (f"a-{card}@x.org", ["email"]),
        (f"+1 {phone} {card}", ["phone", "card"]), (f"{card}.5", ["card"]), (f"9{card}", []), ("12 35 " * 2000, []), ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", ["card"]), ("7" * 30000, []),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pseudonyms.pseudonymised(d, "k").collect():
        text, kinds = cases[r["doc_id"]]
        assert (r["pii_kinds"], text[:60]) == (kinds, text[:60])
        assert ("phone" not in kinds or phone not in r["text"]) and ("card" not in kinds or card not in r["text"].replace(" ", ""))
        assert re.sub("[0-9]", "9", r["text"]) == re.sub("[0-9]", "9", text) or {"email", "address"} & set(kinds)
        assert kinds or r["text"] == text


def test_scores_are_sums_of_tables(spark):
    """Every score against a plain sum over the tables, text by text."""
    rng = random.Random(15)
    docs = [(k, " ".join(rng.choice(["Plain", "words", "of", "A", "text.", "!!", "1999", "the"]) for _ in range(rng.randrange(1, 60)))) for k in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("!!" in t)) for k, t in docs[:300]], "doc_id long, quality int")
    model = quality.train(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(d, model).collect()}
    for i, t in docs:
        x = quality.features(t)
        place = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        total = model.intercept + sum(table[k] for table, k in zip(model.main, place, strict=True)) + sum(table[place[a]][place[b]] for a, b, table in model.pairs)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))) < 1e-12


def _feistel(left, right, size_left, size_right, tag):
    for i in range(1, pseudonyms.ROUNDS + 1):
        half = right if i % 2 else left
        mixed = int(hashlib.sha256(f"{tag}:{i}:{half}".encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + mixed % size_left) % size_left
        else:
            right = (right + mixed % size_right) % size_right
    return left, right


def _digits_for(digits, tag):
    n = len(digits)
    a = n // 2
    l, r = _feistel(int(digits[:a]), int(digits[a:]), 10**a, 10 ** (n - a), f"{tag}:{n}")
    return f"{l:0{a}d}{r:0{n - a}d}"


def test_pseudonyms_are_a_plain_feistel_network(spark):
    """Every kind against a plain version of the network, and that its values stay apart."""
    rng = random.Random(25)
    cards = []
    while len(cards) < 40:
        c = "".join(rng.choice("0123456789") for _ in range(16))
        if _luhn(c):
            cards.append(c)
    phones = [f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(40)]
    addresses = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(40)]
    days = [str(date(1, 1, 1) + timedelta(rng.randrange(3_652_059))) for _ in range(40)] + [str(date(1900, 1, 1) + timedelta(rng.randrange(256 * 287))) for _ in range(40)]
    values = [(v, kind) for kind, vs in (("card", cards), ("phone", phones), ("address", addresses), ("date", days)) for v in vs]
    d = spark.createDataFrame(values, "m string, kind string")
    got = {(r["m"], r["kind"]): r["p"] for r in d.select("m", "kind", pseudonyms.pseudonym(F.col("m"), F.col("kind"), "key").alias("p")).collect()}

    def want(m, kind):
        tag, digits = f"key:{kind}", re.sub("[^0-9]", "", m)
        if kind == "card":
            body = _digits_for(digits[:-1], tag)
            return next(body + c for c in "0123456789" if _luhn(body + c))
        if kind == "phone":
            new = iter(_digits_for(digits, tag))
            return re.sub("[0-9]", lambda _: next(new), m)
        if kind == "address":
            p = list(map(int, m.split(".")))
            halves = _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, tag)
            return ".".join(str(x) for h in halves for x in divmod(h, 256))
        n, first, near = (date.fromisoformat(m) - date(1, 1, 1)).days, 693_595, 256 * 287
        if first <= n < first + near:
            l, r = _feistel(*divmod(n - first, 287), 256, 287, tag)
            return str(date(1900, 1, 1) + timedelta(l * 287 + r))
        l, r = _feistel(*divmod(n - near * (n >= first), 1987), 1801, 1987, tag)
        return str(date(1, 1, 1) + timedelta(l * 1987 + r + near * (l * 1987 + r >= first)))

    assert got == {(m, kind): want(m, kind) for m, kind in values}
    assert len(set(got.values())) == len(got)


def test_pseudonyms_leave_columns_alone(spark):
    """Columns of any name stay as they are."""
    d = spark.createDataFrame([("Call 555-123-4567", "kept", "too", 1)], "text string, __found string, __TEXT string, pii_kinds int")
    out = pseudonyms.pseudonymised(d, "k")
    assert out.columns == ["text", "__found", "__TEXT", "pii_kinds"]
    row = out.first()
    assert (row["__found"], row["__TEXT"], row["pii_kinds"]) == ("kept", "too", ["phone"]) and "555-123-4567" not in row["text"]


def test_waves_of_the_benchmark(spark):
    """Many waves give what one does, and so does a phrase that many items and a long text repeat."""
    phrase = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(k, phrase + f" item{k} ends here now") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"{phrase} " * 3000), (1, "nothing of it"), (2, None), (3, "x " + phrase)], "doc_id long, text string")
    one = {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaked(docs, items).collect()}
    many = {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaked(docs, items, wave_bytes=400).collect()}
    assert one == many == {0: list(range(40)), 1: [], 2: [], 3: list(range(40))}
