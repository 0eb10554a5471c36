"""Requests that are tried again, replayed from recordings: a chain of calls until a reply settles it.

A request's recorded calls are rows (try_no, call_no, status, retry_after, body).  Which call comes after a reply, and how long to wait before it, is a
rule; a chain takes calls in that order until a reply ends it.  A call without a recording ends it too, as an error: a replay asks no one.
A request has a handful of calls at most, so a chain is a fold over an array of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import replies as R

#: Waits before a search's second and third try, how long a service may ask to be waited for, the wait before a model's second call.
SEARCH_WAITS_MS, LONGEST_HINT_S, MODEL_WAIT_MS = (5_000, 15_000), 30, 10_000
_CALL = "struct<try_no: int, call_no: int, status: int, retry_after: string, body: string>"

#: From a call to struct(try_no, call_no, wait_ms) of the one to follow, or null.
Rule = Callable[[Column], Column]


def _next(try_no: Column, call_no: int, wait: Column) -> Column:
    return F.struct(try_no.cast("int").alias("try_no"), F.lit(call_no).alias("call_no"), wait.cast("long").alias("wait_ms"))


def hinted_ms(retry_after: Column) -> Column:
    """What a service asks to be waited, a second at least; null if it says nothing readable or asks for too long."""
    seconds = F.regexp_extract(F.coalesce(retry_after, F.lit("")), r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("long")
    return F.when(seconds <= LONGEST_HINT_S, F.greatest(seconds, F.lit(1)) * 1000)


def search_rule(call: Column) -> Column:
    """Over the limit, once more after the time asked for; a failed search as a new one, for one more hit, after five and then fifteen seconds."""
    tries = len(SEARCH_WAITS_MS)
    wait = F.element_at(F.array(*map(F.lit, SEARCH_WAITS_MS)), F.least(call["try_no"] + 1, F.lit(tries)))
    once_more = (call["status"] == 429) & (call["call_no"] == 0) & hinted_ms(call["retry_after"]).isNotNull()
    return F.when(once_more, _next(call["try_no"], 1, hinted_ms(call["retry_after"]))).when((call["status"] == 400) & (call["try_no"] < tries), _next(call["try_no"] + 1, 0, wait))


def model_rule(call: Column) -> Column:
    """Over the limit, up to three times more; a server error or an empty answer, once; after ten seconds, then twice as long each time."""
    wait = MODEL_WAIT_MS * F.pow(F.lit(2.0), call["try_no"])
    return F.when(F.coalesce(R.should_retry(call["status"], call["body"], call["try_no"]), F.lit(False)), _next(call["try_no"] + 1, 0, wait))


def chains(requests: DataFrame, calls: DataFrame, by: list[str], rule: Rule) -> DataFrame:
    """``requests`` with calls_made, waited_ms, status and body of the reply that settled each, and error.

    ``calls``: by, try_no, call_no (both from 0), status, retry_after, body.  Of calls recorded twice the one of the smallest status, then body, counts.
    error is null for a reply below 400, "HTTP n" for others, and "no recording" where the next call is not recorded; then status is null.
    """
    one = calls.groupBy(*by, "try_no", "call_no").agg(F.min(F.struct("status", "body", "retry_after")).alias("c"))
    call = F.struct(F.col("try_no").cast("int").alias("try_no"), F.col("call_no").cast("int").alias("call_no"), F.col("c.status").cast("int").alias("status"), F.col("c.retry_after").alias("retry_after"), F.col("c.body").alias("body"))
    lists = one.groupBy(*by).agg(F.array_sort(F.collect_list(call)).alias("calls"))

    def step(acc: Column, c: Column) -> Column:
        due = acc["open"] & (acc["try_no"] == c["try_no"]) & (acc["call_no"] == c["call_no"])
        after = rule(c)
        taken = F.struct(
            after.isNotNull().alias("open"), F.coalesce(after["try_no"], c["try_no"]).alias("try_no"), F.coalesce(after["call_no"], c["call_no"]).alias("call_no"), (acc["made"] + 1).alias("made"),
            (acc["waited"] + F.coalesce(after["wait_ms"], F.lit(0))).alias("waited"), c.alias("last"),
        )
        return F.when(due, taken).otherwise(acc)

    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("try_no"), F.lit(0).alias("call_no"), F.lit(0).alias("made"), F.lit(0).cast("long").alias("waited"), F.lit(None).cast(_CALL).alias("last"))
    told = requests.join(lists, by, "left").withColumn("chain", F.aggregate(F.coalesce("calls", F.array().cast(f"array<{_CALL}>")), start, step))
    lost = F.col("chain.open")
    status = F.when(~lost, F.col("chain.last.status"))
    error = F.when(lost, "no recording").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    return told.select(
        *requests.columns, F.col("chain.made").alias("calls_made"), F.col("chain.waited").alias("waited_ms"), status.alias("status"), F.when(~lost, F.col("chain.last.body")).alias("body"), error.alias("error")
    )


def searched(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """Searches (request_id, query, size) by recordings (query, size, call_no, status, retry_after, body): each try asks for one hit more."""
    tries = requests.select("request_id", "query", F.explode(F.sequence(F.lit(0), F.lit(len(SEARCH_WAITS_MS)))).alias("try_no"), F.col("size").alias("__size"))
    calls = tries.withColumn("size", F.col("__size") + F.col("try_no")).join(recordings, ["query", "size"]).select("request_id", "try_no", "call_no", "status", "retry_after", "body")
    return chains(requests, calls, ["request_id"], search_rule)


def asked_models(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """Model calls (request_id, key) by recordings (key, try_no, status, body), with the reply's text."""
    calls = requests.select("request_id", "key").join(recordings, "key").select("request_id", "try_no", F.lit(0).alias("call_no"), "status", F.lit(None).cast("string").alias("retry_after"), "body")
    out = chains(requests, calls, ["request_id"], model_rule)
    told = F.when(F.col("error") == "no recording", F.col("error")).otherwise(R.reply_error(F.col("status"), F.col("body")))
    return out.withColumn("error", told).withColumn("text", F.when(F.col("error").isNull(), R.reply_content(F.col("body"))))
