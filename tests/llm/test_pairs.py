"""Top-k search, SimHash groups, fuzzy lines and preference pairs against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestry.llm import components, lines, preferences, simhash, topk


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 8)), 3)
    x[100:300] = x[7]
    rows = [(int(k), v.tolist(), k % 9 == 0, 1) for k, v in enumerate(x)] + [(800, None, True, 1), (801, [1.0, None], True, 1), (802, [float("nan")] * 8, False, 1), (803, [], True, 1), (804, [1e30] * 8, False, 1), (None, [1.0] * 8, False, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q boolean, rank int").repartition(3)
    got = {}
    for r in topk.top_k(df, F.col("q"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    use = {i: [int(np.floor(1024 * c)) for c in v] + [0] * (8 - len(v)) for i, v, _, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    cap = lambda s: max(-(2**63), min(2**63 - 1, s))
    queries = [i for i, v, q, _ in rows if q and i in use]
    assert set(got) == set(queries)
    for i in queries:
        best = sorted((-cap(sum(a * b for a, b in zip(use[i], v, strict=True))), j) for j, v in use.items() if j != i)[:10]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("q")).collect() == []
    assert len(topk.top_k(df.where("vec_id < 3"), F.lit(True), 10).collect()) == 6
    # Several waves give the same.
    again = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df, F.col("q"), 10, wave=64).collect()}
    assert again == {(q, n): i for q, v in got.items() for n, i, _ in v}


@pytest.mark.parametrize("shape", [(1, 4), (500, 4), (2000, 16)])
def test_cover_tree_covers(shape):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=shape) * 1000)
    tree = topk.CoverTree(x)
    assert sorted(tree.order) == list(range(len(x)))
    for c, r, (a, b) in zip(tree.centre, tree.radius, tree.span, strict=True):
        assert np.linalg.norm(x[tree.order[a:b]] - x[c], axis=1).max() <= r + 1e-6


def test_node_pairs_are_pruned(monkeypatch):
    """Of vectors that lie in clusters, most products are never computed; results stay exact.  A few queries make a tree too."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3000
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 60)
    for n, share in ((24, 0.6), (400, 0.3)):
        q = x[:: 4000 // n][:n] + 1
        done = []
        plain = topk.products
        monkeypatch.setattr(topk, "products", lambda a, b: (done.append(len(a) * len(b)), plain(a, b))[1])
        tree = topk.CoverTree(q, max(4, min(topk.QUERY_LEAF, n // 8)))
        assert any(tree.children)
        ids = [np.array([k]) for k in range(len(x))]
        got = {k: (i.tolist(), s.tolist()) for k, i, s in topk.search(tree, np.arange(10_000, 10_000 + n), topk.CoverTree(x), ids, 10, np.full(n, -np.inf))}
        monkeypatch.undo()
        assert sum(done) < share * n * len(x)
        scores = (q @ x.T).astype(np.int64)
        for k in range(n):
            best = np.lexsort((np.arange(len(x)), -scores[k]))[:10]
            assert got[k] == (best.tolist(), scores[k, best].tolist())


def _plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


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


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Aa", "b", "cé", "dd", "e\x0bf"]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts = base + [t.replace("b", "x", 1) for t in base] + [t + " end" for t in base[:30]] + [None, "", "  ", base[0], base[0], "word " * 30000]
    d = spark.createDataFrame([(1000 - k, t, "f") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    fps = [_plain_fingerprint(t) for t in texts]
    root = _groups(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), 1000 - k)
    for k in range(len(texts)):
        assert (rows[1000 - k]["fingerprint"], rows[1000 - k]["component_id"]) == (f"{fps[k]:016x}", least[root[k]])
    assert simhash.near_duplicates(d.limit(0)).collect() == []


@pytest.mark.parametrize(("block", "tables"), [(4096, 5), (64, 5), (64, 15)])
def test_gray_index_finds_every_link(spark, block, tables):
    rng = random.Random(4)
    codes = {rng.getrandbits(64) for _ in range(200)}
    for c in list(codes)[:40]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                c ^= 1 << b
            codes.add(c)
    codes = sorted(codes)
    signed = [c - (c >> 63 << 64) for c in codes]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = components.components(simhash.linked(df, 4, block, tables), "a", "b").collect()
    root = {s: s for s in signed} | {r["node"]: r["root"] for r in found}
    want = _groups(len(codes), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 4)
    sets = lambda key: sorted(sorted(signed[k] for k in range(len(codes)) if key(k) == x) for x in {key(k) for k in range(len(codes))})
    assert sets(lambda k: root[signed[k]]) == sets(lambda k: want[k])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def _line_set(line):
    s = " ".join(line.lower().split())
    return {s[k : k + 5] for k in range(max(1, len(s) - 4))} if s else None


def test_lines(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    def vary(t):
        w = t.split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)
    docs = [(k, "\n".join([rng.choice(base), vary(rng.choice(base)), "Short one", "", rng.choice(base).upper()]), "k") for k in range(80)]
    docs += [(200, None, "k"), (201, "", "k"), (202, "x" * 500 + "\n" + "x" * 499 + "\nend", "k"), (203, base[0] + "\n" + "\n".join("w" * 3 + str(k) for k in range(5000)), "k"), (5, docs[5][1], "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, key string")
    out = lines.deduplicated(d)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r["text"] for r in rows}
    places = [(i, p, x) for i, t, _ in dict.fromkeys((i, t, 0) for i, t, _ in docs) if t is not None for p, x in enumerate(t.split("\n")) if _line_set(x)]
    places.sort(key=lambda v: v[:2])
    sets = [_line_set(x) for *_, x in places]
    root = _groups(len(places), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    drop = {places[k][:2] for k in range(len(places)) if root[k] != k}
    for i, t, _ in docs:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in drop)
        assert got[i] == want
    assert lines.deduplicated(d.limit(0)).collect() == []


def test_preferences(spark):
    rows = [(0, 0, "user", "Hi"), (0, 1, "assistant", "Hello"), (0, 2, "user", "A?"), (0, 3, "assistant", "B"), (1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "A?"), (1, 3, "assistant", "CC"), (1, 4, "user", None),
            (2, 0, "user", "x"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "z"), (6, 0, None, "n" * 100000), (7, None, "assistant", "q"), (7, None, "assistant", "q")]
    d = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preferences.formatted_by_parity(d).collect()}
    assert set(got) == {0, 2, 3}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[0]["n_shared"] == 3 and got[0]["prompt"] == say("user", "Hi") + say("assistant", "Hello") + say("user", "A?")
    assert got[0]["chosen"] == say("assistant", "B") and got[0]["rejected"] == say("assistant", "CC") + say("user", "")
    a, b = map(int, got[0]["rejected_mask"].split(":"))
    assert got[0]["rejected"][a:b] == "CC<|end|>"
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["chosen_mask"]) == ("", "", "") and got[2]["prompt"] == say("user", "same")
    long = spark.createDataFrame([(8, 0, "user", "hi"), (8, 1, "assistant", "x" * 3_000_000), (9, 0, "user", "hi"), (9, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    (r,) = preferences.formatted_by_parity(long).collect()
    assert r["n_shared"] == 1 and r["chosen"] == say("assistant", "x" * 3_000_000)
    assert got[3]["rejected"] == say("assistant", "q") * 2 and len(got[3]["rejected_mask"].split(",")) == 2
    pairs = spark.createDataFrame([(0, 0, 1), (9, 0, 50)], "pair_id long, chosen_id long, rejected_id long")
    (one,) = preferences.formatted(d, pairs).collect()
    assert one.asDict() == got[0].asDict()
    assert preferences.formatted_by_parity(d.limit(0)).collect() == []


def test_topk_in_waves(spark):
    """Many waves of queries give what one does."""
    rng = random.Random(31)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    find = lambda wave: sorted(map(tuple, topk.top_k(d, F.col("vec_id") % 2 == 0, 5, wave=wave).collect()))
    assert find(64) == find(topk.WAVE) and len(find(64)) == 200 * 5
