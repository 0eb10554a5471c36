"""Mixing, hard negatives and the leaderboard feed against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import leaders, mixing, negatives


def _mined(rows, anchors, k=5, each=3, low=50, high=95, scale=256):
    use = [(i, lab, [int(np.floor(scale * c)) for c in v]) for i, lab, v in rows if None not in (i, lab, v) and all(c is not None and np.isfinite(c) for c in v)]
    out, done = [], set()
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    for i, lab, v in sorted(use):
        if i not in anchors or i in done:
            continue
        done.add(i)
        scored = sorted((-dot(v, w), j, m) for j, m, w in use if j != i)
        for s, j in [(-s, j) for s, j, m in scored if m == lab][:k]:
            near = [(-n, x) for n, x, m in scored if m != lab and low * s <= -100 * n <= high * s][:each]
            out += [(i, j, r + 1, x, s, n) for r, (n, x) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("wave", [64, 16_384])
def test_hard_negatives(spark, wave, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 6)) + 0.4, 2)
    x[50:150] = x[3]
    rows = [(int(k), int(rng.integers(0, 4)), v.tolist()) for k, v in enumerate(x)]
    rows += [(500, None, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None]), (503, 2, [float("nan")] * 6), (504, 2, [float("inf")] * 6), (None, 2, [1.0] * 6), (505, 2, []), (506, 1, [2.0, 1.0]), (9, 3, rows[9][2]), (9, rows[9][1], rows[9][2]), (20, rows[20][1], rows[20][2])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    anchors = {k for k in range(0, 600, 3 if wave == 64 else 9)} | {505}
    got = sorted(map(tuple, negatives.mined(d, F.col("vec_id").isin(*anchors), F.col("label"), wave=wave).collect()))
    # Of an anchor that is there twice, the row of the smallest label, then vector, counts.
    assert got == _mined(sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0)), anchors)
    assert negatives.mined(d.limit(0), F.lit(True), F.col("label")).collect() == []


def test_limits_are_exact():
    for score in range(-300, 300):
        low, high = negatives.limits(score, 50, 95)
        assert [x for x in range(-400, 400) if 50 * score <= 100 * x <= 95 * score] == list(range(low, high + 1))


def _targets(sizes, share, repeats):
    """The rule itself: stop at the limit, share the rest by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        over = {s for s in free if weight[s] * rest / sum(weight[f] for f in free) > repeats * sizes[s]}
        if not over:
            return {s: repeats * sizes[s] if s in full else weight[s] * rest / sum(weight[f] for f in free) for s in names}
        full |= over


def _mix(d, **more):
    rank = F.col("source_rank") % 3
    first = F.when(F.col("source_rank") % 2 == 0, 0.0).otherwise(2.0)
    return mixing.mixed(d, F.when(rank == 0, 3).when(rank == 1, 1).otherwise(2), mixing.straight(first, 2 - first), **more)


def test_mixing(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "ä", "z", "Z", "\U0001f600", "！", None])
        rows.append((k, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 40, 200]))), source))
    rows += [(901, None, "a"), (902, "", "b"), (903, " \t\n", "none here"), (904, "w " * 60_000, "Z"), (904, "w " * 60_000, "Z"), (None, "no id", None), (None, "no id", None), (905, "a\x0bb c d", "tiny")]
    d = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = _mix(d, rows_of_slice=50).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"], r["source"] or "") for r in got) == sorted((i or -1, words(t), s or "") for i, t, s in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = _targets(sizes, 1.5, 2)
    cut = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(p["words"] for p in r["passes"]) and [p["pass"] for p in r["passes"]] == list(range(len(r["passes"])))
        taken[r["source"]] += r["taken"]
        cut[r["source"]] += r["size"] > 0 and r["taken"] % r["size"] > 0
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want) and max(cut.values()) <= 1
    ats = [r["passes"][0]["at"] for r in got if r["passes"]]
    assert ats == sorted(ats) and [bool(r["passes"]) for r in got] == sorted((bool(r["passes"]) for r in got), reverse=True)
    assert sorted(map(repr, got)) == sorted(map(repr, _mix(d.repartition(5), rows_of_slice=50).collect()))
    # By a time, a source has had as much of its target as its schedule has of its integral.
    for s in ("a", "b"):
        rising = sorted(x for x in sizes if x is not None).index(s) % 2 == 0
        passes = sorted((p["at"], p["words"]) for r in got if r["source"] == s for p in r["passes"])
        for t in (0.25, 0.5, 0.75):
            share = t * t if rising else 2 * t - t * t
            assert sum(w for at, w in passes if at <= t) == pytest.approx(share * want[s], abs=200)
    assert _mix(d.limit(0)).collect() == [] and all(r["taken"] == 0 for r in _mix(d.where("doc_id in (901, 902)")).collect())


def test_schedules_invert(spark):
    """Straight lines between any knots, flat and empty stretches too."""
    knots = [(0.0, 0.0), (0.2, 3.0), (0.5, 3.0), (0.5, 1.0), (0.6, 0.0), (0.8, 0.0), (1.0, 2.0)]
    d = spark.createDataFrame([(knots, k / 50) for k in range(51)], "knots array<struct<at: double, level: double>>, share double")
    area = lambda t: np.trapezoid([np.interp(x, *zip(*knots, strict=True)) for x in np.linspace(0, t, 20_001)], np.linspace(0, t, 20_001))
    ats = [r["at"] for r in d.select("share", mixing.due(mixing.integrated(F.col("knots")), F.col("share")).alias("at")).orderBy("share").collect()]
    assert ats == sorted(ats) and ats[0] == 0 and ats[-1] == pytest.approx(1)
    assert all(area(at) / area(1.0) == pytest.approx(k / 50, abs=1e-3) for k, at in enumerate(ats))


def _feed(rows, late=15):
    """Boards after every arrival day, from all of a group's revenues."""
    seen, revenue, board, out = None, defaultdict(lambda: defaultdict(int)), defaultdict(dict), []
    for b in sorted({r[5] for r in rows if r[5] is not None}):
        own = [r for r in rows if r[5] == b]
        for day in sorted({r[2] for r in own if r[2] is not None}):
            touched = set()
            for g, i, d, v, s, _ in own:
                if d == day and None not in (g, i, v) and (seen is None or s is None or s + late >= seen):
                    revenue[g][i] += v
                    touched.add(g)
            for g in touched:
                new = {i: k + 1 for k, (r, i) in enumerate(sorted((-r, i) for i, r in revenue[g].items() if r > 0)[:10])}
                for i in new.keys() | board[g].keys():
                    a, z = board[g].get(i), new.get(i)
                    if a != z:
                        out.append((g, day, i, "enter" if a is None else "exit" if z is None else "move", a, z, revenue[g][i]))
                board[g] = new
        seen = max([x for x in [seen] if x is not None] + [r[4] for r in own if r[4] is not None], default=None)
    return sorted(out)


def test_change_feed(spark):
    rng = random.Random(8)
    rows = []
    for b in range(1, 4):
        for _ in range(700):
            stamp = 10 * b + rng.randrange(-20, 10)
            rows.append((rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(60), rng.randrange(9), None if rng.random() < 0.1 else 5]), 100 * b + rng.randrange(12), rng.choice([rng.randrange(-400, 500), 100, -300]), stamp, b))
    rows += [(2, 3, 150, 10**15, None, 1), (2, None, 150, 5, 90, 2), (1, 1, 310, None, 5, 3), rows[5], rows[5]]
    d = spark.createDataFrame([(*r, 1) for r in rows], "group int, item_id long, day long, value long, stamp long, batch int, revenue int").repartition(3)
    got = sorted(map(tuple, leaders.change_feed(d).collect()), key=repr)
    assert got == sorted(_feed(rows), key=repr) and {"enter", "exit", "move"} == {r[3] for r in got}
    assert leaders.change_feed(d.limit(0)).collect() == []


def test_cache_is_exact_under_any_updates():
    """Leaders out of a small cache equal those of the whole, with refills whenever leaders fall away."""
    rng = random.Random(9)
    cache, whole, refills = leaders.Cache(board=3, slack=5, full=8), {}, 0
    for _ in range(20_000):
        item = rng.randrange(40)
        whole[item] = whole.get(item, 0) * 9 // 10 + rng.randrange(-50, 55)
        cache.put(item, whole[item])
        if cache.short():
            refills += 1
            cache.refill(np.array(list(whole)), np.array(list(whole.values())))
        assert cache.leaders() == {i: -r for r, i in sorted((-r, i) for i, r in whole.items() if r > 0)[:3]}
        assert len(cache.held) < 8
    assert refills > 50
