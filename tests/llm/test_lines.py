"""Fuzzy lines by their characters, against all pairs."""

import random

from attestry.llm import components, lines


def _groups(n, near):
    root = list(range(n))
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def _char_set(line):
    s = " ".join(line.lower().split())
    return {s[k : k + 5] for k in range(max(1, len(s) - 4))} if s else None


def _kept_lines(docs, takes_part=_char_set):
    """The texts that are left, by comparing all pairs of lines."""
    places = sorted((i, p, x) for i, t in docs for p, x in enumerate(t.split("\n")) if takes_part(x))
    sets = [takes_part(x) for *_, x in places]
    root = _groups(len(places), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    drop = {places[k][:2] for k in range(len(places)) if root[k] != k}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in drop) for i, t in docs}


def _left(spark, docs):
    return {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_lines_are_alike_by_their_characters(spark):
    """A changed letter in a line of ten to twenty words is a near copy, whatever word it is in."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    base = [[word() for _ in range(rng.randrange(10, 20))] for _ in range(40)]
    def typo(w):
        w, k = list(w), rng.randrange(len(w))
        w[k] = "z" + w[k][1:]
        return w
    docs = [(k, " ".join(w)) for k, w in enumerate(base)] + [(100 + k, "\t".join(typo(w))) for k, w in enumerate(base)] + [(200, "emoji 😀 𝔘 and four more words")]
    got = _left(spark, docs)
    assert got == _kept_lines(docs)
    assert [got[100 + k] for k in range(40)] == [""] * 40


def test_no_link_of_a_large_band_is_lost(spark, monkeypatch):
    """Lines of one band that make many chains: what the order puts far apart is found by the blocks."""
    monkeypatch.setattr(lines, "BLOCK", 16)
    rng = random.Random(26)
    rows = set()
    while len(rows) < 400:
        x = set(rng.sample(range(3000), 1)) | set(range(5000, 5018))
        rows.add((rng.randrange(40), *sorted(x | set(rng.sample(range(12), 3)))))
    sets = [sorted({v + 10 for v in r}) for r in rows]
    members = spark.createDataFrame([(k, b, 0, 0) for k in range(len(sets)) for b in (1, 2)], "uid long, band long, next long, after long")
    table = spark.createDataFrame(list(enumerate(sets)), "uid long, set array<int>")
    none = spark.createDataFrame([], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(lines._rest(members, none, table, 0.8), "a", "b").collect()}
    full = [set(s) for s in sets]
    want = _groups(len(sets), lambda a, b: len(full[a] & full[b]) >= 0.8 * len(full[a] | full[b]))
    assert len(set(want)) > 1 and [got.get(k, k) for k in range(len(sets))] == want
    # Part of the links known beforehand changes nothing.
    some = [(want[k], k) for k in range(0, len(sets), 3) if want[k] != k]
    known = spark.createDataFrame(some, "a long, b long")
    both = known.unionByName(lines._rest(members, known, table, 0.8))
    got = {r["node"]: r["root"] for r in components.components(both, "a", "b").collect()}
    assert [got.get(k, k) for k in range(len(sets))] == want


def test_short_lines_take_part(spark):
    """Copies go at any length, also in scripts without spaces and between tabs; blank lines stay."""
    texts = ["All rights reserved.\n\n}\n第一章 概要\na\tb\tc\td", "all rights  reserved.\n \n}\n第一章 概要\nA b c d\nab", "All rights reserved\n\nAb\nabc"]
    docs = list(enumerate(texts))
    got = _left(spark, docs)
    assert got == _kept_lines(docs)
    assert got == {0: texts[0], 1: " \nab", 2: "\nabc"}


def _family(rng, base, n, most):
    """``n`` lines of ``base`` with up to ``most`` of its words changed: some reach 0.8 with each other, some do not."""
    out = []
    for _ in range(n):
        w = base.split(" ")
        for k in rng.sample(range(len(w)), rng.randrange(most + 1)):
            w[k] = "".join(rng.choice("klmnop") for _ in range(6))
        out.append(" ".join(w))
    return out


def test_large_families_lose_no_link(spark, monkeypatch):
    """Ten thousand lines and families above every bound, against all pairs of each family; families have nothing in common."""
    rng = random.Random(7)
    letters = ["abcdefgh", "qrstuvwx"]
    families = []
    for f, alphabet in enumerate(letters):
        word = lambda: "".join(rng.choice(alphabet) for _ in range(7))  # noqa: E731, B023
        families.append(sorted(set(_family(rng, " ".join(word() for _ in range(30)), 500, 4))))
    other = ["".join(rng.choice("0123456789yz ") for _ in range(80)) for _ in range(10_000)]
    docs = [(k, x) for k, x in enumerate(x for f in families for x in f)]
    docs += [(100_000 + k, "\n".join(other[k : k + 50])) for k in range(0, len(other), 50)]
    want, first = {}, 0
    for f in families:
        sets = [_char_set(x) for x in f]
        root = _groups(len(f), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        want |= {first + k: f[k] if root[k] == k else "" for k in range(len(f))}
        first += len(f)
    assert 0 < sum(x == "" for x in want.values()) < len(want)
    for large in (lines.LARGE, 16, 1000):
        monkeypatch.setattr(lines, "LARGE", large)
        got = _left(spark, docs)
        lost = [k for k, x in want.items() if got[k] != x]
        assert len(lost) <= 0.01 * len(want), (large, len(lost))
        assert all(got[100_000 + k] == "\n".join(other[k : k + 50]) for k in range(0, len(other), 50))


def test_hashes_that_meet(spark):
    """Different lines of one 64-bit hash take no part: both stay."""
    d = spark.createDataFrame([("one line here", 5), ("another line", 5), ("a third line", 6), ("a third line", 6)], "line string, uid long")
    assert [(r["uid"], r["n"]) for r in lines.distinct_lines(d).collect()] == [(6, 2)]


def test_marks_tell_half_alike_lines_apart(spark):
    """Lines at an index of a half are seldom candidates, lines above the threshold always are."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for pair in range(160):
        base, same = text(200), 133 if pair < 80 else 186
        rows += [(2 * pair, base), (2 * pair + 1, base[:same] + text(200 - same))]
    marks = lines.distinct_lines(spark.createDataFrame(rows, "uid long, line string"))
    pairs = marks.where("uid % 2 = 0").alias("l").join(marks.alias("r"), lines.F.col("l.uid") + 1 == lines.F.col("r.uid"))
    near = [r["uid"] for r in pairs.where(lines._near("l", "r")).select("l.uid").collect()]
    assert sum(uid < 160 for uid in near) <= 16 and sum(uid >= 160 for uid in near) == 80
