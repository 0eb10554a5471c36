"""Preference formatting: one prompt and two masked completions for a chosen and a rejected conversation.

The longest common prefix of turns is rendered once, as the prompt; what follows it in either conversation is that side's
completion.  A completion's mask lists the spans (in characters of the completion) that a loss may look at: the assistant's turns with
their end marks.  Everything is array and string functions; a conversation's turns are brought together once, by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _side(turns: Column, shared: Column) -> tuple[Column, Column]:
    """The completion after ``shared`` turns, and its mask as start:end pairs."""
    rest = F.slice(turns, shared + 1, F.size(turns))
    text = F.array_join(F.transform(rest, _rendered), "")

    def add(state: Column, turn: Column) -> Column:
        body = F.length(F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))) + state["at"]
        end = state["at"] + F.length(_rendered(turn))
        span = F.concat(body.cast("string"), F.lit(":"), (end - 1).cast("string"))  # up to the end mark, without its line break
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return text, F.array_join(F.aggregate(rest, start, add, lambda s: s["spans"]), ",")


def formatted(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask for every row of ``pairs`` (pair_id, chosen_id, rejected_id).

    Turns are ordered by turn number, then role and text; repeated rows are turns of their own.  A null role or text is the empty string, a null
    turn number comes first, and rows without a conv_id belong to no conversation.  A pair of which either side has no turns gives no row.  If one side is
    the beginning of the other its completion is empty.  Very long texts are rendered whole; an empty table gives no rows; other columns are ignored.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    side = lambda id_col, name: turns.select(F.col("conv_id").alias(id_col), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen_id", "c"), "chosen_id").join(side("rejected_id", "r"), "rejected_id")
    return _emit(both)


def _emit(both: DataFrame) -> DataFrame:
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, short), F.slice("r", 1, short), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("n_shared", F.when(differs > 0, differs - 1).otherwise(short).cast("int"))
    shared = F.col("n_shared")
    (chosen, chosen_mask), (rejected, rejected_mask) = _side(F.col("c"), shared), _side(F.col("r"), shared)
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_shared",
        F.array_join(F.transform(F.slice("c", 1, shared), _rendered), "").alias("prompt"),
        chosen.alias("chosen"), rejected.alias("rejected"), chosen_mask.alias("chosen_mask"), rejected_mask.alias("rejected_mask"),
    )


def formatted_by_parity(conversations: DataFrame) -> DataFrame:
    """``formatted`` for tables in which conversation 2k is the chosen and 2k + 1 the rejected one of pair k.

    Both sides of a pair meet in the one exchange that brings their turns together.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.col("conv_id") % 2 == 0
    turns = lambda mine: F.array_sort(F.collect_list(F.when(mine, said)))
    both = (
        conversations.where(F.col("conv_id").isNotNull())
        .groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"))
        .agg(turns(first).alias("c"), turns(~first).alias("r"))
        .where((F.size("c") > 0) & (F.size("r") > 0))
        .select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"), "c", "r")
    )
    return _emit(both)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_by_parity(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM t
), m AS (
  SELECT a.pair_id, a.conv_id, a.i, coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM n a LEFT JOIN n b ON a.pair_id = b.pair_id AND a.conv_id <> b.conv_id AND a.i = b.i
), k AS (
  SELECT pair_id, CAST(least(coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)), max(i)) AS INTEGER) AS n_shared
  FROM m GROUP BY pair_id HAVING count(DISTINCT conv_id) = 2
), s AS (
  SELECT n.*, k.n_shared, n.i > k.n_shared AS after,
    coalesce(sum(CASE WHEN n.i > k.n_shared THEN length(said) END) OVER (PARTITION BY conv_id ORDER BY n.i), 0) AS ends FROM n JOIN k USING (pair_id)
)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, n_shared,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (WHERE NOT after AND conv_id % 2 = 0), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (WHERE after AND conv_id % 2 = 0), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (WHERE after AND conv_id % 2 <> 0), '') AS rejected,
  coalesce(string_agg(CAST(ends - length(said) + length(role) + 5 AS BIGINT) || ':' || CAST(ends - 1 AS BIGINT), ',' ORDER BY i)
    FILTER (WHERE after AND role = 'assistant' AND conv_id % 2 = 0), '') AS chosen_mask,
  coalesce(string_agg(CAST(ends - length(said) + length(role) + 5 AS BIGINT) || ':' || CAST(ends - 1 AS BIGINT), ',' ORDER BY i)
    FILTER (WHERE after AND role = 'assistant' AND conv_id % 2 <> 0), '') AS rejected_mask
FROM s GROUP BY pair_id, n_shared
"""
