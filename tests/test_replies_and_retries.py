"""Readers of replies, and chains of tries, on small inputs; queries hold them against SQL on the tables."""

import json

from pyspark.sql import functions as F

from attestry.operators import checks, editing, library, replies, retries


def test_readers(spark):
    web = json.dumps({"results": [{"url": "https://a.org/x", "title": "A", "content": "c"}, {"title": "no address"}, {"url": "https://en.wikipedia.org/wiki/X"}, {"url": "https://b.org"}]})
    d = spark.createDataFrame([(1, web), (2, "not JSON"), (3, None), (4, "{}")], "id int, body string")
    assert [(r["id"], r["seq"], r["url"], r["title"]) for r in replies.web_results(d, ["id"]).orderBy("seq").collect()] == [(1, 0, "https://a.org/x", "A"), (1, 3, "https://b.org", None)]
    message = json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": "b"}]})
    output = json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": "x"}, {"type": "other", "text": "no"}]}, {"type": "call"}, {"type": "message", "content": [{"type": "text", "text": "y"}]}]})
    d = spark.createDataFrame([(message, output), ("x", "x"), (None, None)], "m string, o string")
    assert [tuple(r) for r in d.select(replies.message_text(F.col("m")), replies.output_text(F.col("o"))).collect()] == [("ab", "x\ny"), ("", ""), ("", "")]
    v = spark.createDataFrame([("supports",), ("partial",), ("unsupported",), (None,)], "v string")
    assert [r[0] for r in v.select(checks.archive_check_wanted(F.col("v"))).collect()] == [True, True, False, False]
    e = spark.createDataFrame([(["p" * 2000, "q" * 2000], ["w", ""]), ([], ["only"])], "p array<string>, w array<string>")
    one, two = (r[0] for r in e.select(library.evidence(F.col("p"), F.col("w"))).collect())
    assert one == ("p" * 2000 + "\n…\n" + "q" * 2000)[:3000] + "\n\n---\n\nw" and two == "only"


def test_search_chains(spark):
    asked = spark.createDataFrame([(k, f"q{k}", 50) for k in range(7)], "request_id int, query string, size int")
    calls = [
        ("q0", 50, 0, 200, None, "ok"), ("q1", 50, 0, 400, None, "a"), ("q1", 51, 0, 400, None, "b"), ("q1", 52, 0, 200, None, "c"), ("q2", 50, 0, 400, None, "a"), ("q2", 51, 0, 400, None, "b"), ("q2", 52, 0, 400, None, "c"),
        ("q3", 50, 0, 429, "7", ""), ("q3", 50, 1, 400, None, ""), ("q3", 51, 0, 429, "40", "x"), ("q4", 50, 0, 429, "0", ""), ("q5", 50, 0, 503, None, "e"), ("q5", 51, 0, 200, None, "never"),
    ]
    recorded = spark.createDataFrame(calls, "query string, size int, call_no int, status int, retry_after string, body string")
    got = {r["query"]: (r["calls_made"], r["waited_ms"], r["status"], r["body"], r["error"]) for r in retries.searched(asked, recorded).collect()}
    assert got == {
        "q0": (1, 0, 200, "ok", None), "q1": (3, 20_000, 200, "c", None), "q2": (3, 20_000, 400, "c", "HTTP 400"), "q3": (3, 12_000, 429, "x", "HTTP 429"),
        "q4": (1, 1_000, None, None, "no recording"), "q5": (1, 0, 503, "e", "HTTP 503"), "q6": (0, 0, None, None, "no recording"),
    }
    assert retries.searched(asked.limit(0), recorded).collect() == []


def test_model_chains(spark):
    said = lambda text: json.dumps({"choices": [{"message": {"content": text}}]})
    asked = spark.createDataFrame([(k, f"k{k}") for k in range(4)], "request_id int, key string")
    calls = [("k0", n, 429, "") for n in range(3)] + [("k0", 3, 200, said("late")), ("k1", 0, 502, ""), ("k1", 1, 502, ""), ("k2", 0, 200, said(" ")), ("k2", 1, 200, said("hm"))] + [("k3", n, 429, "") for n in range(5)]
    recorded = spark.createDataFrame(calls, "key string, try_no int, status int, body string")
    got = {r["key"]: (r["calls_made"], r["waited_ms"], r["text"], r["error"]) for r in retries.asked_models(asked, recorded).collect()}
    assert got["k0"] == (4, 70_000, "late", None) and got["k2"] == (2, 10_000, "hm", None)
    assert got["k1"][:3] == (2, 10_000, None) and got["k1"][3].startswith("HTTP 502") and got["k3"][:3] == (4, 70_000, None)


def test_claim_positions(spark):
    text = "Old text here. The mill burnt down.{{cn}} It was old.{{fact}}"
    rows = [(1, 0, False, None), (2, 1, False, None), (3, 5, False, None), (4, None, True, "The mill burnt down"), (5, None, True, "never said so"), (6, None, False, None)]
    d = spark.createDataFrame([(i, text, n, p, c, "") for i, n, p, c in rows] + [(7, None, 0, False, None, "")], "id int, wikitext string, nth int, picked boolean, claim string, before string")
    got = {r["id"]: (r["start"], r["end"]) for r in editing.claim_positions(d, ["id"]).collect()}
    tag, end = text.index("{{cn}}"), text.index("{{fact}}")
    assert got == {1: (tag, tag + 6), 2: (end, end + 8), 3: (None, None), 4: (tag, tag), 5: (None, None), 6: (None, None), 7: (None, None)}
