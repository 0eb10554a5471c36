"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, lines, packing, quality, simhash
from attestry.llm._shared import durable, released, sent, table, written


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and all other columns in one, so that no operator's own columns can meet theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *rest).alias("rest"))


def _whole(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject.

    Null and empty texts are scored like any other.  Rows that repeat an id are scored each by its own text, and repeated rows stay or go
    together.  A null id has no label and is scored.  Columns beside id and text are carried along, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _whole(quality.scored(_apart(docs), model, keep_text=True).where("predicted = 1"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line is like; n_chars, where there is one, follows the text.

    Null texts stay null, and a document all of whose lines are repeated stays with an empty text.  Rows that agree in id and text keep
    the same lines; rows that only share an id are different documents.
    """
    out = lines.deduplicated(_apart(docs))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("rest")["n_chars"])
        out = out.withColumn("rest", F.col("rest").withField("n_chars", changed.cast(docs.schema["n_chars"].dataType)))
    return _whole(out, docs)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row with the smallest id, then the smallest hash of its text.

    Every row is a document, whether or not its id repeats: a group's other rows go by id and text, so that a row of the same id in another
    group stays.  Of rows that agree in id and text one stays.  Null and empty texts are one group, as their fingerprints are equal.  A
    null id comes last: a row without id stays only in a group that has none.
    """
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    groups = durable(simhash.near_duplicates(docs.select(row.alias("row"), "text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id"))
    gone = groups.where("row <> component_id").select("row").distinct()
    again = groups.where("row = component_id").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(True).alias("again"))
    keyed = docs.select(F.struct(*docs.columns).alias("all"), row.alias("row"))
    kept = sent(sent(keyed, gone, "row", "left_anti", 64), again, "row", "left", 64)
    once = kept.where("again IS NULL").unionByName(kept.where("again").dropDuplicates(["row"]))
    return once.select(*[F.col("all")[c].alias(c) for c in docs.columns])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; every row is looked at by itself, so repeated ids and rows stay or go by their own text.
    """
    return _whole(decontaminate.leaked(_apart(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaked_items") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every piece of every document, with its sequence and place.  A null text is packed like an empty one; every row is packed."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_a_kind),
    ("decontaminate", keep_clean),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one's is written."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, out = out, stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out)
            if k:
                released(before)
    return out
