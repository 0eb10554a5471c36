"""Exact medians by ranges of values."""

import random
import statistics

from attestry.operators import evaluation


def test_medians(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.0, 2.0, 2.0, 1000 * rng.random()])) for _ in range(5000)] + [("one", 7.5), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 9.0), (None, 9.0), ("none", None)]
    rows += [("ties", 5.0)] * 400 + [("wide", 10.0 ** rng.randrange(-9, 9)) for _ in range(999)]
    d = spark.createDataFrame(rows, "kind string, ms double")
    want = {k: statistics.median([v for x, v in rows if x == k and v is not None]) for k in {k for k, v in rows if v is not None}}
    for parts in (4, 256):
        assert {r["kind"]: r["median"] for r in evaluation.medians(d, ["kind"], "ms", parts).collect()} == want
    calls = evaluation.usage(d.selectExpr("kind", "ms", "1 AS tokens"), ["kind"], "ms", "tokens")
    assert {r["kind"]: (r["calls"], r["median_ms"]) for r in calls.collect() if r["kind"] in ("none", None, "one")} == {"none": (1, None), None: (3, 9.0), "one": (1, 7.5)}
    assert evaluation.medians(d.limit(0), ["kind"], "ms").collect() == []
